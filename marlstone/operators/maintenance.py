"""Incremental maintenance of chunk tables and manifests, and versioned tables with one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.plans import cut


def orphan_prune(indexed: DataFrame, source_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Indexed rows whose document the source still has. An empty source prunes nothing: it is taken for a failed read."""
    if source_ids.isEmpty():
        return indexed
    return indexed.join(source_ids.select(key).distinct(), key, "left_semi")


def orphans(indexed: DataFrame, source_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The document ids that `orphan_prune` drops."""
    ids = indexed.select(key).distinct()
    return ids.limit(0) if source_ids.isEmpty() else ids.join(source_ids.select(key), key, "left_anti")


def number_chunks(new: DataFrame, last_id: int, order: list[str], id: str = "chunk_id") -> DataFrame:
    """New chunks with ids after the high-water mark, which never falls, in the order given. Ids are dense and dealt per
    partition of the sorted rows: counts first, offsets second, so no single task sees all rows."""
    s = cut(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = s.groupBy("_p").agg(F.count("*").alias("_size"), F.min("_m").alias("_first"))  # one row a partition
    offsets = sizes.select("_p", "_first", (F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return s.join(F.broadcast(offsets), "_p").withColumn(id, F.col("_m") - F.col("_first") + F.coalesce("_before", F.lit(0)) + F.lit(last_id + 1)).drop("_p", "_m", "_first", "_before")


def upsert_chunks(indexed: DataFrame, changed: DataFrame, last_id: int, order: list[str], key: str = "doc_id", id: str = "chunk_id", source_ids: DataFrame | None = None) -> DataFrame:
    """Chunks after an update: those of changed documents replaced, orphans dropped, new ones numbered on."""
    kept = indexed.join(changed.select(key).distinct(), key, "left_anti")
    if source_ids is not None:
        kept = orphan_prune(kept, source_ids, key)
    return kept.unionByName(number_chunks(changed, last_id, order, id), allowMissingColumns=True)


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old entries and the new ones with unseen ids; entries without an id are always kept."""
    none = F.coalesce(F.col(key), F.lit("")) == ""
    unseen = new.filter(~none).dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(unseen.select(*old.columns)).unionByName(new.filter(none).select(*old.columns))


def high_water_mark(documents: DataFrame, time: str = "modified_time") -> DataFrame:
    """The last change, and the start of the next read (a day before)."""
    return documents.agg(F.max(time).alias("last_modified")).withColumn("read_from", F.col("last_modified") - F.expr("interval 1 day"))


def changed_since(documents: DataFrame, since: str, time: str = "modified_time") -> DataFrame:
    return documents.filter(F.col(time) >= F.lit(since).cast("timestamp"))


def reread_excluded(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pages that weren't excluded, or changed after they were. pages: id, time; excluded: id, excluded_time."""
    return pages.join(excluded, "id", "left").filter("excluded_time is null or time > excluded_time or time is null").drop("excluded_time")


def permanent_exclusions(manifest: DataFrame, prefix: str = "noise_") -> DataFrame:
    """Ids that are never read again: those excluded as noise."""
    return manifest.filter(F.col("reason").startswith(prefix)).select("id").distinct()


def cached_prefixes(chunks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with their contextual prefix from the cache, by document, chunk hash and model, and the chunks that miss one."""
    from marlstone.functions.text import chunk_fingerprint

    c = chunks.withColumn("chunk_hash", chunk_fingerprint(F.col("doc_id"), F.col("chunk")))
    j = c.join(cache.filter(F.col("model") == model).select("doc_id", "chunk_hash", "prefix"), ["doc_id", "chunk_hash"], "left")
    long = F.length("chunk") >= 80
    hit = j.withColumn("indexed_text", F.when(long & F.col("prefix").isNotNull(), F.concat_ws("\n\n", "prefix", "chunk")).otherwise(F.col("chunk")))
    return hit, j.filter(long & F.col("prefix").isNull()).drop("prefix")


class VersionedTables:
    """Sets of tables that change together: each version is a folder, and one pointer file names the current one.

    A reader that took a version keeps it; a crash before the pointer is written leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hp = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hp(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        tmp = self._hp(f"{self.path}/_CURRENT.{version}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(version, "ascii"))
        out.close()
        target = self._hp(f"{self.path}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(tmp, target, options)
        return version

    def current(self) -> str | None:
        p = self._hp(f"{self.path}/CURRENT")
        if not self._fs.exists(p):
            return None
        return self.spark.read.text(p.toString(), wholetext=True).first()[0].strip()

    def read(self, name: str, version: str | None = None) -> DataFrame:
        v = version or self.current()
        if v is None:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{v}/{name}")


def _write_text(spark: SparkSession, fs, folder: str, name: str, text: str) -> None:
    """A small file put in its place at once: readers see the old or the new one."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    tmp = path(f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(tmp, path(f"{folder}/{name}"), options)


class BucketedTable:
    """A table of chunks in buckets by the hash of their document, of which an update rewrites only those it touches.

    A manifest file names the folder of each bucket, the highest id, and the last applied batch; it is replaced at once, so a
    reader sees a whole version and a crash leaves the old one. Folders of earlier versions stay for readers that hold them.
    """

    MANIFEST = "MANIFEST"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "doc_id", id: str = "chunk_id"):
        self.spark, self.path, self.buckets, self.key, self.id = spark, path.rstrip("/"), buckets, key, id
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.MANIFEST}")
        if not self._fs.exists(p):
            return {"buckets": self.buckets, "folders": {}, "last_id": 0, "batch": None}
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64(self.key), F.lit(m["buckets"])).cast("int")

    def read(self, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if there is nothing yet."""
        m = manifest or self.manifest()
        folders = sorted({f for b, f in m["folders"].items() if only is None or int(b) in only})
        if not folders:
            return None
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.drop("version", "bucket")

    def apply(self, changed: DataFrame, order: list[str], batch: str | None = None, removed: DataFrame | None = None) -> int:
        """Chunks of changed documents replace those there were, documents of `removed` (the key) go; new chunks are numbered on.
        A batch that was the last one applied is skipped. Returns the number of buckets rewritten."""
        m = self.manifest()
        if batch is not None and batch == m["batch"]:
            return 0
        changed = cut(changed)
        keys = changed.select(self.key)
        if removed is not None:
            keys = keys.unionByName(removed.select(self.key))
        touched = sorted(r[0] for r in keys.select(self._bucket(m).alias("b")).distinct().collect())  # at most `buckets` numbers
        if not touched:
            return 0
        new = number_chunks(changed, m["last_id"], order, self.id)
        old = self.read(m, touched)
        if old is not None:
            new = old.join(keys.distinct(), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        version = f"version={uuid.uuid4().hex}"
        new = cut(new)
        new.withColumn("bucket", self._bucket(m)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        held = {r[0] for r in new.select(self._bucket(m).alias("b")).distinct().collect()}
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {str(b): f"{version}/bucket={b}" for b in touched if b in held}
        last = new.agg(F.max(self.id)).first()[0]
        _write_text(self.spark, self._fs, self.path, self.MANIFEST, json.dumps({"buckets": m["buckets"], "folders": folders, "last_id": max(m["last_id"], last or 0), "batch": batch}))
        return len(touched)


def save_run(df: DataFrame, folder: str, name: str) -> str:
    """A run's rows as JSON lines in a file of their own, and a `latest` pointer to it. Returns the path."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    path = f"{folder}/{name}"
    df.coalesce(1).write.json(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    _write_text(spark, fs, folder, "latest", name)
    return path


def latest_run(spark: SparkSession, folder: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/latest")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.json(f"{folder.rstrip('/')}/{spark.read.text(p.toString(), wholetext=True).first()[0].strip()}")


def new_and_modified(pages: DataFrame, since: Column | str, created: str = "created", modified: str = "modified") -> DataFrame:
    """Pages changed since a time, each told to be new (made since then) or modified: the pages' columns and change."""
    t = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    return pages.filter(F.col(modified) >= t).withColumn("change", F.when(F.coalesce(F.col(created) >= t, F.lit(False)), "new").otherwise("modified"))


def to_fetch(listed: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """Listed items that weren't fetched with success yet (failed and skipped ones are tried again), once each. state: key, status."""
    return listed.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(state.filter("status = 'success'").select(key).distinct(), key, "left_anti")


def fetch_state(state: DataFrame, outcomes: DataFrame, key: str = "id") -> DataFrame:
    """The state after a fetch: each item's last outcome. state, outcomes: key, status, error, at."""
    both = state.unionByName(outcomes)
    return both.groupBy(key).agg(F.max_by(F.struct("status", "error", "at"), F.struct("at", "status")).alias("_s")).select(key, "_s.*")


def fetch_statistics(state: DataFrame) -> DataFrame:
    """One row: total, successful, failed, skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    return state.agg(F.count("*").alias("total"), n("success").alias("successful"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def write_categorized(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """File names for entries (category, title, url): an entry whose address is known in its category and title replaces that
    file; another address gets the next ` (2)` to ` (99)`; entries without an address always get a name of their own. Entries
    past 99 of a category and title replace file 99. Every entry has a row.
    existing: category, title, url, file_name. Result: category, title, url, file_name, replaces."""
    e = cut(entries.withColumn("_i", F.monotonically_increasing_id()))  # read twice: the numbers must stay
    same = existing.filter("coalesce(url, '') <> ''").groupBy("category", "title", "url").agg(F.min("file_name").alias("old"))
    j = e.join(same, ["category", "title", "url"], "left")
    taken = existing.groupBy("category", "title").agg(F.count("*").alias("taken"))
    first = F.when(F.coalesce("url", F.lit("")) == "", F.col("_i").cast("string")).otherwise(F.col("url"))
    new = j.filter("old is null").withColumn("_k", first)
    order = new.groupBy("category", "title", "_k").agg(F.min("_i").alias("_f")).withColumn("_n", F.row_number().over(Window.partitionBy("category", "title").orderBy("_f")))
    new = new.join(order, ["category", "title", "_k"]).join(taken, ["category", "title"], "left")
    number = F.col("_n") + F.coalesce("taken", F.lit(0))
    stem = F.concat_ws("/", "category", "title")
    named = new.select("category", "title", "url", F.concat(stem, F.when(number > 1, F.concat(F.lit(" ("), F.least(number, F.lit(99)).cast("string"), F.lit(")"))).otherwise(""), F.lit(".md")).alias("file_name"), (number > 99).alias("replaces"))
    return j.filter("old is not null").select("category", "title", "url", F.col("old").alias("file_name"), F.lit(True).alias("replaces")).unionByName(named)


def collection_manifest(documents: DataFrame, chunks: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per collection: documents, chunks, last_modified, and constants such as the reader or the embedder.
    documents: collection, doc_id, modified_time; chunks: collection."""
    c = chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
    d = documents.groupBy("collection").agg(F.count("*").alias("documents"), F.max("modified_time").alias("last_modified"))
    out = d.join(c, "collection", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return out.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})


def check_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame, if it has the columns of these types; else an error that names what a damaged artifact lacks."""
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in columns.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"not the expected table: {wrong}")
    return df

"""Helpers that shape physical plans: reading tables, spreading work, cutting lineage, choosing joins."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a side is broadcast once it has been counted (a few columns each: tens of MB at most).
BROADCAST_ROWS = 200_000


def session(app: str = "marlstone", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Round-robin `df` when it has fewer partitions than the cluster has cores (one small file, say);
    a large scan has more already and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a temporary one of this machine, in local mode only: the executors
    of a cluster couldn't read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named:
        if not held.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not held.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder and read from there: its lineage ends, lost executors cost nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, lean: bool = False) -> DataFrame:
    """As `cut`, but as a Parquet table (compressed, column-pruned), for wide frames that are read several times. lean: packed
    closer, and the shuffle files it took are deleted at once, not whenever the driver collects its garbage."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/marlstone-stage-{uuid.uuid4().hex}"
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup)
    try:
        if lean:
            conf.set(cleanup, "true")
        (df.write.option("compression", "zstd") if lean else df.write).parquet(path)
    finally:
        conf.set(cleanup, before)
    _STAGES.append(path)
    out = df.sparkSession.read.parquet(path)
    out._marlstone_stage = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes tables that `staged` wrote, which nothing reads any more."""
    for df in frames:
        spark, name = df.sparkSession, df._marlstone_stage
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _STAGES.remove(name)


_STAGES: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables staged so far in this session, once nothing reads them any more (after a result was written);
    what `kept` wrote stays. Returns their number."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    n = 0
    while _STAGES:
        p = path(_STAGES.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


def content_key(df: DataFrame) -> str | None:
    """A key of what a frame reads and does: its files with their sizes and times, and its plan (as text, of which Spark may leave
    out fields of wide frames, and as a hash). None where it reads no files."""
    files = df.inputFiles()
    if not files:
        return None
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(files):
        status = path(f).getFileSystem(conf).getFileStatus(path(f))
        seen.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr((seen, df._jdf.queryExecution().analyzed().canonicalized().toString(), df.semanticHash())).encode()).hexdigest()[:32]


def kept(df: DataFrame, name: str, key: str | None) -> DataFrame:
    """As `staged`, but once for each key: a later call with the same name and key reads what was written, also in another
    session that shares the folder. Two writers at once write the same; the table is complete once it has its success mark."""
    if key is None:
        return staged(df)
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/marlstone-kept-{name}-{key}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder, "_SUCCESS")):
        own = f"{folder}.{uuid.uuid4().hex}"
        df.write.parquet(own)
        if not fs.rename(path(own), path(folder)) or fs.exists(path(folder, own.rsplit("/", 1)[1])):
            return spark.read.parquet(own if fs.exists(path(own)) else f"{folder}/{own.rsplit('/', 1)[1]}")
    return spark.read.parquet(folder)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small: it is counted, broadcast up to `rows` rows, else shuffled
    (AQE then splits hot keys). `small` should be cheap to count (a file, or cut)."""
    return big.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields, given as DDL."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def hash_sample(df: DataFrame, rows: int, id: list[str]) -> DataFrame:
    """About `rows` rows of `df` (all, if it has no more), the same in every run: those whose id hashes low enough. The id
    must be nearly unique: values that repeat so often that more than twice the rows would be drawn are an error."""
    n = df.count()
    if n <= rows:
        return df
    drawn = df.filter(F.pmod(F.xxhash64(*id), F.lit(1 << 40)) < int((1 << 40) * (rows / n)))
    if drawn.limit(2 * rows + 1).count() > 2 * rows:
        raise ValueError(f"{id} repeats too often for a sample by hash")
    return drawn


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, unless they find it on PYTHONPATH: Python functions refer to its modules."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_marlstone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(f"{folder}/marlstone", "zip", root, "marlstone"))
    sc._marlstone_shipped = True


def in_order(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows dealt to partitions by ranges of (group, order), with the partition's number in `_p`: a hot group is spread over
    several. Written once, as the numbers must not change between uses."""
    return staged(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_p", F.spark_partition_id()))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of `value` up to each row of its group in order, without a task that sees a whole group: sums within each range
    of rows, and the totals of the ranges before it. Ties in `order` are taken in any order."""
    d = in_order(df.withColumn("_v", value), group, order)
    totals = d.groupBy(*group, "_p").agg(F.sum("_v").alias("_t"))  # one row a group and range
    before = totals.withColumn("_b", F.sum("_t").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    own = d.withColumn(name, F.sum("_v").over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("_p") == F.col("_bp")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    before = before.select(F.col("_p").alias("_bp"), "_b", *[F.col(c).alias(f"_b_{c}") for c in group])
    return own.join(before, same).withColumn(name, F.col(name) + F.coalesce("_b", F.lit(0))).drop("_p", "_v", "_b", "_bp", *[f"_b_{c}" for c in group])


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that isn't null up to each row of its group in order; as `running_sum`, no task sees a whole group."""
    d = in_order(df, group, order)
    own = d.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    held = d.groupBy(*group, "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_t"))
    before = held.withColumn("_b", F.last("_t", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("_p") == F.col("_bp")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    before = before.select(F.col("_p").alias("_bp"), "_b", *[F.col(c).alias(f"_b_{c}") for c in group])
    return own.join(before, same).withColumn(name, F.coalesce(name, "_b")).drop("_p", "_b", "_bp", *[f"_b_{c}" for c in group])


def register_views(spark: SparkSession, sf_dir: str, tables: list[str], queries: dict | None = None) -> list[str]:
    """Temporary views of tables and of query results, for SQL: each query is a view of its own name."""
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, query in (queries or {}).items():
        query(spark, sf_dir).createOrReplaceTempView(name)
    return [*tables, *(queries or {})]

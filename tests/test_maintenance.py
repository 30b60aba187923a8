from pyspark.sql import functions as F

from marlstone.operators import cleanup, collection_queries as cq, convert, ledger, maintenance as mt
from marlstone.operators.graph import subtree


def test_orphans_and_empty_source(spark):
    idx = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "chunk_id long, doc_id string")
    src = spark.createDataFrame([("b",)], "doc_id string")
    assert {r["chunk_id"] for r in mt.orphan_prune(idx, src).collect()} == {2, 3}
    assert mt.orphan_prune(idx, src.limit(0)).count() == 3 and mt.orphans(idx, src).first()[0] == "a"


def test_upsert_numbers_on(spark):
    idx = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "chunk_id long, doc_id string, chunk string")
    new = spark.createDataFrame([("b", "y2"), ("c", "z"), ("c", "z2")], "doc_id string, chunk string")
    got = sorted((r["chunk_id"], r["doc_id"], r["chunk"]) for r in mt.upsert_chunks(idx, new, 7, ["doc_id", "chunk"]).collect())
    assert got == [(1, "a", "x"), (8, "b", "y2"), (9, "c", "z"), (10, "c", "z2")]


def test_upsert_of_whole_texts(spark, tmp_path):
    long = "# A\n" + "first words " * 900 + "\n# B\n" + "other words " * 900
    rows = [
        (1, long, "u", "2024-01-01 00:00:00"), (2, long + " end", "u", "2024-03-01 00:00:00"), (3, "short", None, "2024-01-02 00:00:00"), (4, long + " x", None, "2024-02-29 12:00:00"),
        (5, "", "v", "2024-02-29 13:00:00"), (6, "old", "w", None), (7, "no time", None, None), (8, "newer", "w", "2024-01-01 00:00:00"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, url string, at string").selectExpr("doc_id", "text", "url", "cast(at as timestamp) as modified_time").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {i: [(k, c["heading"], c["text"]) for k, c in enumerate(convert.heading_sections(t))] if t else [] for i, t, _, _ in rows}
    assert len(parts[2]) > 3 and sum(len(x[2]) for x in parts[2]) > 10_000
    index = [(n, i, *c) for n, (i, c) in enumerate(((i, c) for i in sorted(parts) for c in parts[i]), 1)]
    kept = [x for x in index if x[1] not in (1, 6)]
    assert sorted(map(tuple, cq.pruned_chunks(spark, str(tmp_path)).collect())) == [x[:3] for x in kept]
    new = [(len(index) + n, i, *c) for n, (i, c) in enumerate(((i, c) for i in (2, 4, 5) for c in parts[i]), 1)]
    assert sorted(map(tuple, cq.upserted_chunks(spark, str(tmp_path)).collect())) == [x for x in kept if x[1] not in (2, 4, 5)] + new


def test_manifest_keeps_entries_without_id(spark):
    s = "id string, title string"
    got = mt.merge_manifest(spark.createDataFrame([("1", "a"), ("", "b")], s), spark.createDataFrame([("1", "c"), ("2", "d"), ("", "e"), (None, "f")], s))
    assert sorted((r["id"] or "", r["title"]) for r in got.collect()) == [("", "b"), ("", "e"), ("", "f"), ("1", "a"), ("2", "d")]


def test_all_labels_are_tags(spark, tmp_path):
    spark.createDataFrame([(1, ["alpha", "vault"]), (2, ["proxy", "vault"]), (3, None)], "ingest_id long, labels array<string>").write.parquet(f"{tmp_path}/jira_issues.parquet")
    spark.createDataFrame([(1, "s", {"tags": "vault, alpha,vault"}), (2, None, {"tags": "proxy,zebra"}), (3, "s", None)], "doc_id long, source string, metadata map<string,string>").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, cq.labelled_tags(spark, str(tmp_path)).collect())) == [(1, "alpha"), (1, "vault"), (2, "proxy")]


def test_every_article_gets_a_file(spark, tmp_path):
    rows = [(1, "A", "One two", "u1"), (2, "a", "One two", "u2"), (3, None, None, None), (4, "a", "One two", None), (5, "a", "One two", "u1"), (6, "a", "One two", ""), (7, "a", "One", "u1")]
    spark.createDataFrame(rows[::-1], "ingest_id long, category string, title string, url string").write.parquet(f"{tmp_path}/articles.parquet")
    got = sorted((r["url"] or "", r["file_name"], r["replaces"]) for r in cq.article_files(spark, str(tmp_path)).collect())
    assert got == [("", "a/One two (3).md", False), ("", "a/One two (4).md", False), ("", "none/untitled.md", False), ("u1", "a/One two.md", False), ("u1", "a/One two.md", False), ("u1", "a/One.md", False), ("u2", "a/One two (2).md", False)]


def test_files_past_99_replace_the_last(spark):
    e = spark.range(103).selectExpr("'c' as category", "'t' as title", "if(id % 2 = 0, cast(id as string), null) as url")
    got = mt.write_categorized(e, e.limit(0).withColumn("file_name", F.lit(""))).collect()
    assert len(got) == 103 and len({r["file_name"] for r in got}) == 99
    assert {r["file_name"] for r in got if r["replaces"]} == {"c/t (99).md"} and sum(r["replaces"] for r in got) == 4


def test_versions(spark, tmp_path):
    store = mt.VersionedTables(spark, str(tmp_path / "v"))
    assert store.current() is None
    a = store.write({"t": spark.range(2).toDF("x")})
    held = store.read("t")
    b = store.write({"t": spark.range(5).toDF("x")})
    assert store.current() == b != a and store.read("t").count() == 5 and held.count() == 2


def test_streamed_upsert(spark, tmp_path):
    from marlstone.streaming.incremental import upsert_stream

    src, store = str(tmp_path / "in"), mt.VersionedTables(spark, str(tmp_path / "v"))
    schema = "doc_id string, chunk string"
    for rows in ([("a", "1"), ("b", "1")], [("b", "2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark.readStream.schema(schema).parquet(src), store, "chunks", str(tmp_path / "c"), ["doc_id"]).awaitTermination()
    assert sorted((r["doc_id"], r["chunk"]) for r in store.read("chunks").collect()) == [("a", "1"), ("b", "2")]


RECORD = "seq long, collection string, runId string, job string, trigger string, variant string, startedAt string, finishedAt string, status string, source string, stage string, documentCount long, chunkCount long, error string, phases array<struct<name:string,status:string,fatal:boolean,startedAt:string,durationSeconds:int>>"


def record(seq, run, **k):
    base = dict(seq=seq, collection="c", runId=run, job=None, trigger=None, variant=None, startedAt=None, finishedAt=None, status=None, source="engine", stage=None, documentCount=None, chunkCount=None, error=None, phases=None)
    return tuple({**base, **k}.values())


def test_ledger_fold(spark):
    fetch, embed = ("fetch", "ok", True, "2024-01-01T10:00:00Z", 5), ("embed", "failed", False, None, None)
    rows = [
        record(1, "r1", source="script", stage="begin", job="j", trigger="timer", variant="incremental", startedAt="2024-01-01T10:00:00Z"),
        record(2, "r1", documentCount=7, variant="guess", startedAt="2024-01-01 10:01:00", finishedAt="2024-01-01T10:08:00+00:00", phases=[embed], error="late"),
        record(3, "r1", source="script", stage="end", variant="full", documentCount=1, finishedAt="2024-01-01T10:10:00Z", phases=[fetch, ("embed", "ok", False, "2024-01-01T09:00:00Z", 3)]),
        record(4, None, status="ok"), record(5, None, status="ok"),
        record(6, "r2", source="script", stage="begin", startedAt="2024-01-01T00:00:00Z"), record(7, "r3", source="script", stage="begin", startedAt="2024-01-01T11:30:00Z"),
    ]
    got = {r["run"]: r for r in ledger.fold_runs(spark.createDataFrame(rows, RECORD), "2024-01-01 12:00:00").collect()}
    r = got["r1"]
    assert (r["job"], r["trigger"], r["variant"], r["document_count"], r["duration_s"], r["status"], r["error"]) == ("j", "timer", "full", 7, 600, "degraded", "late")
    assert [(p["name"], p["status"], p["durationSeconds"]) for p in r["phases"]] == [("embed", "failed", 3), ("fetch", "succeeded", 5)]
    assert len([k for k in got if k.startswith("anonymous")]) == 2
    assert got["r2"]["status"] == "incomplete" and got["r3"]["status"] == "running" and got["r2"]["duration_s"] is None


def test_subtree(spark):
    nodes = spark.createDataFrame([(x,) for x in "esqtuz"], "id string")
    edges = spark.createDataFrame([("s", "e", "in"), ("q", "e", "in"), ("t", "s", "sub"), ("u", "q", "sub"), ("gone", "e", "in")], "source string, target string, type string")
    roots = spark.createDataFrame([("e",), ("none",)], "root string")
    got, walked = subtree(nodes, edges, roots)
    assert {(r["id"], r["depth"]) for r in got.collect()} == {("e", 0), ("s", 1), ("q", 1), ("t", 2), ("u", 2)}
    assert walked.count() == 4
    assert subtree(nodes, edges, roots, max_nodes=1)[0].count() == 2


def test_body_reasons(spark):
    rows = [(1, "  "), (2, "https://x.y/z"), (3, "tiny"), (4, "word " * 30), (5, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", cleanup.classify_body(F.col("t"), 20, cleanup.LINE_NOISE["confluence"], 40).alias("r"))
    assert {r["i"]: r["r"] for r in df.collect()} == {1: "empty_stub", 2: "reference_only", 3: "minimal_content", 4: "low_word_count", 5: "empty_stub"}

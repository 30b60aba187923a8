import json

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import cleanup, convert as cv, graph, ledger, maintenance as mt, quality, search, traces
from marlstone.sources import files


def test_page_properties(spark):
    props = {"Name": {"type": "title", "title": [{"plain_text": "x"}]}, "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, "When": {"type": "date", "date": {"start": "2024-01-01", "end": "2024-01-03"}}, "Done": {"type": "checkbox", "checkbox": False}, "Sum": {"type": "rollup", "rollup": {"type": "number", "number": 3}}, "F": {"type": "formula", "formula": {"type": "string", "string": "s"}}, "Empty": {"type": "select", "select": None}}
    got = [r[0] for r in spark.createDataFrame([(json.dumps(props),), ("{bad",), (None,)], "p string").select(cv.page_properties("p")).collect()]
    assert got[0].split("\n") == ["**Tags:** a, b", "**When:** 2024-01-01 - 2024-01-03", "**Done:** no", "**Sum:** 3", "**F:** s"]
    assert got[1] is None and got[2] == ""


def test_tags_and_answers(spark):
    df = spark.createDataFrame([("<html><head><meta charset='u'></head>",), ('<meta name="keywords" content="old">x',), ("plain",)], "h string")
    assert [r[0] for r in df.select(cv.inject_html_tags(F.col("h"), F.array(F.lit("a$1"), F.lit("b")))).collect()] == ["<html><head><meta charset='u'>\n<meta name=\"keywords\" content=\"a$1, b\"></head>", '<meta name="keywords" content="a$1, b">x', '<meta name="keywords" content="a$1, b">\nplain']
    md = spark.createDataFrame([("---\ntitle: t\ntags: [old]\n---\nbody",), ("body",)], "t string").select(cv.inject_tags(F.col("t"), F.array(F.lit("x"))))
    assert [r[0] for r in md.collect()] == ["---\ntitle: t\ntags: [x]\n---\nbody", "---\ntags: [x]\n---\nbody"]
    a = spark.createDataFrame([("CATEGORY: Tech/Code\nSUMMARY: two\nlines",), ("nothing",)], "a string").select(cv.category_and_summary(F.col("a")).alias("s")).collect()
    assert (a[0].s.category, a[0].s.summary) == ("tech/code", "two\nlines") and a[1].s.category is None
    u = spark.createDataFrame([([("Read", '{"file_path": "a.py"}'), ("Bash", '{"command": "ls"}'), ("Odd", "{}")],)], "u array<struct<name:string,input:string>>")
    assert u.select(cv.tool_summary(F.col("u"))).first()[0] == ["Read: a.py", "Bash: ls", "Odd"]
    j = spark.createDataFrame([('```json\n["a", "b",]\n```',), ('{"tags": ["c"]}',), ("none",)], "t string").select(tx.json_strings("t"))
    assert [r[0] for r in j.collect()] == [["a", "b"], ["c"], None]


def test_guarded_records_and_schema(spark):
    phases = "phases array<struct<name:string,detail:string>>"
    df = spark.createDataFrame([(1, [("a", "x"), ("b", "y" * 3000), ("c", None)], "e"), (2, [], "z" * 70_000), (3, None, None)], f"n int, {phases}, error string")
    got = {r["n"]: json.loads(r["record"]) for r in cv.guarded_records(df).collect()}
    assert got[1] == {"n": 1, "phases": [{"name": "a", "detail": "x"}, {"name": "b", "detailTruncated": True}, {"name": "c"}], "error": "e"}
    assert len(got[2]["error"]) == 2048 and got[3] == {"n": 3}
    one = spark.createDataFrame([("x",), ("y" * 3000,)], "d string")
    assert [json.loads(r["record"])["d"] for r in cv.guarded_records(one).collect()] == ["x", "y" * 3000]
    assert mt.check_schema(one, {"d": "string"}) is one
    try:
        mt.check_schema(one, {"d": "int"})
        raise AssertionError
    except ValueError:
        pass


def test_descriptions_and_chapters(spark):
    text = "About this.\nMore of it.\n\nSubscribe now\n00:00 Intro\n1:05 - Second part\n1:05 again"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(cv.description_summary(F.col("t"))).collect()] == ["About this. More of it.", ""]
    assert sorted((r["start"], r["title"]) for r in cv.chapters_of(df, "id", "t").collect()) == [(0, "Intro"), (65, "Second part")]


def test_session_logs(spark, tmp_path):
    rows = [{"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hello <system-reminder>x</system-reminder>"}}, {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": json.dumps([{"type": "text", "text": "hi"}, {"type": "tool_use", "text": None}])}},
            {"type": "user", "sessionId": "s", "isMeta": True, "message": {"role": "user", "content": "meta"}}, {"type": "user", "sessionId": "s", "isSidechain": True, "message": {"role": "user", "content": "side"}}, {"type": "summary"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    m = files.read_sessions(spark, str(tmp_path / "s.jsonl"))
    assert [(r["role"], r["text"]) for r in m.orderBy("pos").collect()] == [("user", "hello"), ("assistant", "hi")]
    assert files.session_markdown(m, 2).first()["markdown"] == "## User\n\nhello\n\n## Assistant\n\nhi" and files.session_markdown(m, 3).count() == 0


def test_run_logs(spark):
    lines = ["2024-01-01 10:00:00 starting update", "noise", "2024-01-01 10:05:00 finished", "2024-01-02 10:00:00 starting update", "2024-01-02 10:01:00 FAILED", "2024-01-03 10:00:00 starting update"]
    got = files.parse_run_log(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos int, line string")).orderBy("nth").collect()
    assert [r["status"] for r in got] == ["succeeded", "failed", "incomplete"]


def test_graph_files(spark, tmp_path):
    for i, label in enumerate(("first", None)):
        (tmp_path / f"a{i}-graph.json").write_text(json.dumps({"nodes": [{"id": "n", "type": "T", "label": label, "properties": {"k": str(i)}}], "edges": [{"source": "n", "target": "m", "type": "e", "properties": {"k": str(i)}}]}))
    paths = files.graph_files([str(tmp_path), "/nowhere"], ["extra"])[:2]
    nodes, edges = files.read_graphs(spark, paths)
    n, e = graph.merge_nodes(nodes).collect(), graph.merge_edges(edges).collect()
    assert [(r["label"], r["properties"]) for r in n] == [("first", {"k": "1"})] and [r["properties"] for r in e] == [{"k": "0"}]


def test_schedules(spark, tmp_path):
    import plistlib

    (tmp_path / "a.plist").write_bytes(plistlib.dumps({"Label": "a", "StartCalendarInterval": [{"Hour": 3, "Minute": 30, "Weekday": 1}]}))
    (tmp_path / "b.plist").write_text("broken")
    s = files.read_schedules([str(tmp_path / "a.plist"), str(tmp_path / "b.plist")])
    assert s == [{"name": "a", "hour": 3, "minute": 30, "weekday": 1, "interval_s": None}]
    df = spark.createDataFrame([("2024-01-03 12:00:00", 3, 30, 1, None), ("2024-01-01 02:00:00", 3, 30, 1, None), ("2024-01-01 04:00:00", 3, 30, None, None), ("2024-01-01 04:40:00", None, 15, None, None), ("2024-01-01 04:00:00", None, None, None, 600)], "n string, h int, m int, w int, i int")
    got = [str(r[0]) for r in df.select(ledger.next_fire(F.col("n").cast("timestamp"), F.col("h"), F.col("m"), F.col("w"), F.col("i"))).collect()]
    assert got == ["2024-01-08 03:30:00", "2024-01-01 03:30:00", "2024-01-02 03:30:00", "2024-01-01 05:15:00", "2024-01-01 04:10:00"]


def test_quality_of_matches(spark):
    results = spark.createDataFrame([(1, 0, "x/Other.md"), (1, 1, "x/My-Page.md"), (2, 0, "ABC-12 thing")], "query_id int, rank int, doc_id string")
    expected = spark.createDataFrame([(1, "my page"), (2, "ABC-12: else"), (3, "gone")], "query_id int, expected string")
    got = {r["expected"]: r["rank"] for r in quality.match_expected(results, expected).collect()}
    assert got == {"my page": 1, "ABC-12: else": 0, "gone": None}
    assert quality.shared_top(results, results).filter("query_id = 1").first()["shared"] == 2
    c = spark.createDataFrame([(0, "a", 1.0), (0, "a", 3.0), (1, "b", 5.0)], "config_no int, config string, score double")
    assert {r["config"]: r["delta"] for r in quality.config_averages(c).collect()} == {"a": 0.0, "b": 3.0}


def test_traces_and_logs(spark):
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:04:59"), ("c", "2024-01-01 00:05:00")], "trace_id string, s string").withColumn("stored_at", F.to_timestamp("s"))
    assert {r["trace_id"] for r in traces.live_traces(t, "2024-01-01 00:05:00").collect()} == {"b", "c"}
    q = spark.createDataFrame([(1, "x" * 400), (2, "y")], "query_id int, query string")
    r = spark.createDataFrame([(1, "d", 0, 0.5)], "query_id int, doc_id string, position int, relevance double")
    got = {x["query_id"]: x for x in traces.query_log(r, q, "now").collect()}
    assert len(got[1]["query"]) == 300 and got[1]["top_doc"] == "d" and got[2]["result_count"] == 0


def test_entities_and_answers(spark):
    nodes = spark.createDataFrame([("issue:AB-1", "Issue", "one"), ("epic:AB-2", "Epic", "two"), ("entity:api", "T", "api"), ("entity:big api", "T", "Big API"), ("entity:x", "T", "x")], "id string, type string, label string").withColumn("properties", F.create_map().cast("map<string,string>"))
    edges = spark.createDataFrame([("issue:AB-1", "epic:AB-2", "belongs_to_epic")], "source string, target string, type string")
    texts = spark.createDataFrame([(1, "Which issues belong under AB-2?"), (2, "the big api, bæapi x"), (3, None)], "text_id int, text string")
    found = graph.detect_entities(texts, nodes)
    assert {(r["text_id"], r["node_id"]) for r in found.collect()} == {(1, "epic:AB-2"), (2, "entity:api"), (2, "entity:big api")}
    assert [r["answer"] for r in graph.answer_questions(texts, found, nodes, edges).collect()] == ["epic:AB-2 belongs_to_epic: one"]
    assert [r["terms"] for r in graph.expansion_terms(found, nodes, edges).collect()] == [["one"]]
    seed = graph.narrower_seed(texts, nodes, spark.createDataFrame([("entity:api", 3)], "id string, mentions int")).filter("text_id = 2").first()
    assert seed["node_id"] == "entity:big api" and seed["shared"] == 2


def test_extractions_and_provenance(spark):
    e = spark.createDataFrame([(1, "API", "A"), (2, "api ", "B"), (3, "Api", "B"), (3, None, "B")], "doc_id int, name string, type string")
    r = spark.createDataFrame([(1, "api", "gone", "uses"), (1, "API", "api", "is"), (2, "api", "Api", "is")], "doc_id int, source string, target string, type string")
    nodes, edges = graph.merge_extractions(e, r)
    n = nodes.first()
    assert (n["id"], n["type"], n["mentions"], n["documents"]) == ("entity:api", "B", 3, [1, 2, 3]) and edges.first()["n"] == 2 and edges.count() == 1
    p = graph.provenance(spark.createDataFrame([("g", "c", 5), ("h", "d", 5)], "graph string, collection string, stamped int"), spark.createDataFrame([("c", "5")], "collection string, current string"))
    assert {x["graph"]: x["stale"] for x in p.collect()} == {"g": False, "h": True}


def test_tagging_and_names(spark):
    f = spark.createDataFrame([("a/x.md", "text"), ("a/.h.md", "t"), ("a/y.md", "---\ntags: [a]\n---\n"), (".excluded/z.md", "t"), ("a/w.txt", "t")], "path string, text string")
    assert [r["path"] for r in search.tagging_candidates(f, "*.md").collect()] == ["a/x.md"]
    v = spark.createDataFrame([("a-b.c",), ("a/b",), ("..",)], "n string").select(search.valid_collection(F.col("n")))
    assert [r[0] for r in v.collect()] == [True, False, False]
    r = spark.createDataFrame([("what is the plan of this",), ("hva er planen",), ("api",)], "q string").select(search.wants_reranking(F.col("q"), True))
    assert [x[0] for x in r.collect()] == [False, True, True]


def test_redaction(spark):
    df = spark.createDataFrame([("password: secret a@b.se 31066407457",), ("x@example.com File@f.xsl",), (None,)], "t string").select(cleanup.redact(F.col("t")))
    assert [r[0] for r in df.collect()] == ["password: <redacted-password> <redacted-email> 310664*****", "x@example.com File@f.xsl", None]

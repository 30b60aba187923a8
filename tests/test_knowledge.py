import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import graph, knowledge, search

NODES = [
    ("buc:LA_BUC_01", "BUC", "LA_BUC_01", {}), ("buc:LA_BUC_02", "BUC", "LA_BUC_02", {}), ("sed:A001", "SED", "A001", {"title": "Request"}), ("sed:A002", "SED", "A002", {}), ("sed:X001", "SED", "X001", {}),
    ("artikkel:12", "Artikkel", "Artikkel 12", {"forordning": "987/2009"}), ("artikkel:13", "Artikkel", "Artikkel 13", {}), ("artikkel:13.1", "Artikkel", "Artikkel 13 nr. 1", {}), ("forordning:883/2004", "Forordning", "883/2004", {}),
    ("epic:AB-1", "Epic", "Big plan", {"summary": "All of the plan", "issue_count": "22"}), ("issue:AB-2", "Issue", "x" * 70, {"status": "Open"}), ("issue:AB-3", "Issue", "Third", {}),
    ("entity:api", "System", "API", {"mention_count": "4"}), ("entity:long", "Term", "one two three four five six seven eight", {}), ("entity:odd", "Term", "C++ (new)", {}), ("entity:x", "Term", "xy", {}),
]
EDGES = [
    ("buc:LA_BUC_02", "sed:A001", "inneholder_sed"), ("buc:LA_BUC_02", "sed:A002", "inneholder_sed"), ("buc:LA_BUC_01", "sed:A001", "inneholder_sed"), ("buc:LA_BUC_02", "artikkel:13", "hjemlet_i"), ("artikkel:13.1", "artikkel:13", "del_av"),
    ("issue:AB-2", "epic:AB-1", "tilhører_epic"), ("issue:AB-3", "epic:AB-1", "tilhører_epic"), ("issue:AB-3", "issue:AB-2", "refererer_til"), ("entity:api", "entity:long", "uses"), ("entity:odd", "entity:api", "calls"),
]


@pytest.fixture(scope="module")
def knows(spark):
    nodes = spark.createDataFrame([(*n, "clash") for n in NODES], "id string, type string, label string, properties map<string,string>, position string")
    return nodes, spark.createDataFrame(EDGES, "source string, target string, type string")


def detect(spark, knows, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    found = graph.detect_entities(df, knows[0])
    rows = sorted(found.collect(), key=lambda r: (r["text_id"], r["kind_no"], r["position"], r["node_id"]))
    return df, found, [[r["node_id"] for r in rows if r["text_id"] == i] for i in range(len(texts))]


def test_codes_of_every_kind(spark, knows):
    texts = [
        "LA_BUC_01 and LABUC2, la buc 02", "hva er a001? X001, x001, A999", "art. 13 nr. 1 og artikkel 12", "art 13", "forordning 883/2004, 111/2004", "AB-3 then AB-1, AB-9 ab-2", "", None, "A001 og A001 igjen",
        "the api, rapid", "bæapi", "One  two three four five six seven eight", "one two three four five six seven nine", "in C++ (new)!", "C (new)", "LA BUC 02 a001, art. 13 nr. 1, forordning 883/2004 in AB-1",
    ]
    _, _, got = detect(spark, knows, *texts)
    assert got == [
        ["buc:LA_BUC_01", "buc:LA_BUC_02"], ["sed:A001", "sed:X001"], ["artikkel:13.1", "artikkel:13", "artikkel:12"], ["artikkel:13"], ["forordning:883/2004"], ["issue:AB-3", "epic:AB-1"], [], [], ["sed:A001"],
        ["entity:api"], [], [], [], ["entity:odd"], [], ["buc:LA_BUC_02", "sed:A001", "artikkel:13.1", "artikkel:13", "forordning:883/2004", "epic:AB-1"],
    ]
    assert detect(spark, knows, "so one two three four five six seven EIGHT.")[2] == [["entity:long"]]  # a label of more words than are looked up
    assert graph.detect_entities(spark.createDataFrame([(1, "api AB-1")], "text_id int, text string"), knows[0].limit(0)).count() == 0


def test_terms_contexts_and_answers(spark, knows):
    texts = ["Hvilke SEDer har LA BUC 02?", "Hvilke BUCer bruker A001", "hjemmel: what article for LA BUC 02", "which issues in AB-1", "which epic has AB-3", "LA BUC 02 SEDer", "what is the api"]
    df, found, _ = detect(spark, knows, *texts)
    terms = {r["text_id"]: r["terms"] for r in knowledge.typed_terms(found, *knows).collect()}
    assert terms[0] == ["LA_BUC_02", "Artikkel 13", "A001 Request", "A002"]
    assert terms[1] == ["A001", "LA_BUC_01", "LA_BUC_02"]
    assert terms[3] == ["Big plan", "All of the plan"] and terms[4] == ["Third", "Big plan", "x" * 60]
    assert terms[6] == ["API", "one two three four five six seven eight", "C++ (new)"]
    assert {r["text_id"]: r["terms"] for r in knowledge.typed_terms(found, *knows, 2).collect()}[0] == ["LA_BUC_02", "Artikkel 13"]
    context = {r["id"]: r["context"] for r in knowledge.typed_contexts(*knows).collect()}
    assert context["sed:A001"] == "A001: Request | Del av LA_BUC_01, LA_BUC_02" and context["sed:A002"] == "Del av LA_BUC_02" and "sed:X001" not in context
    assert context["buc:LA_BUC_02"] == "LA_BUC_02 | Hjemlet i Artikkel 13 (Forordning 883/2004) | SEDer: A001, A002" and context["buc:LA_BUC_01"] == "LA_BUC_01 | SEDer: A001"
    assert context["artikkel:12"] == "Artikkel 12 (Forordning 987/2009)" and context["artikkel:13"] == "Artikkel 13 (Forordning 883/2004) | Brukes i LA_BUC_02"
    assert context["epic:AB-1"] == "Big plan | 22 issues" and context["issue:AB-3"] == "Third | Epic: All of the plan" and "forordning:883/2004" not in context
    assert context["entity:api"] == "API (System) | uses one two three four five six seven eight, C++ (new) calls | 4 mentions"
    answers = {r["text_id"]: r["answer"] for r in knowledge.typed_answers(df, found, *knows).collect()}
    assert answers == {
        0: "**LA_BUC_02** inneholder disse SEDene:\n- A001: Request\n- A002", 1: "**A001** inngår i: LA_BUC_01, LA_BUC_02", 2: "**LA_BUC_02** er hjemlet i: Artikkel 13",
        3: f"**Big plan** har 2 issues:\n- {'x' * 70} [Open]\n- Third", 4: "**Third** tilhører epic: Big plan",
    }


def test_many_issues_are_counted(spark):
    nodes = spark.createDataFrame([("epic:EE-1", "Epic", "E", {})] + [(f"issue:EE-{i:03d}", "Issue", f"i{i:03d}", {}) for i in range(100, 130)], "id string, type string, label string, properties map<string,string>")
    edges = spark.createDataFrame([(f"issue:EE-{i:03d}", "epic:EE-1", "tilhører_epic") for i in range(100, 130)], "source string, target string, type string")
    df = spark.createDataFrame([(1, "hva inneholder EE-1"), (2, "hva er EE-1"), (3, None)], "text_id int, text string")
    got = {r["text_id"]: r["answer"] for r in knowledge.typed_answers(df, graph.detect_entities(df, nodes), nodes, edges).collect()}
    assert set(got) == {1} and got[1].startswith("**E** har 30 issues:\n- i100\n") and got[1].endswith("- i119\n- ... og 10 til")


def test_hints(spark, knows):
    texts = ["A001 and what", "the big thing", "api help (old)", "zz yy", "", None]
    df, found, _ = detect(spark, knows, *texts)
    got = {r["text_id"]: r for r in knowledge.retry_hints(df, found, *knows).collect()}
    assert got[0]["entities"] == ["A001"] and got[0]["related_terms"] == ["LA_BUC_01", "LA_BUC_02"] and got[0]["narrower_query"] is None and got[0]["broader_query"] is None
    assert (got[1]["narrower_query"], got[1]["narrower_strategy"]) == ("the big thing Third", "fallback_seed") or got[1]["narrower_query"] == f"the big thing {'x' * 70}"
    assert (got[1]["broader_query"], got[1]["broader_strategy"]) == ("the big", "drop_last_word")
    assert got[2]["broader_query"] == "api help" and got[2]["broader_strategy"] == "trailing_parens" and got[2]["related_terms"][0].startswith("one two")
    assert set(got) == {0, 1, 2}


def test_titles_get_contexts(spark, knows):
    results = spark.createDataFrame([(1, 0, "A001 and A002 in LA BUC 01, art 13"), (1, 1, "nothing"), (2, 0, "A001")], "query_id int, position int, title string")
    asked = spark.createDataFrame([(1,)], "query_id int")
    got = {(r["query_id"], r["position"]): r["graph_context"] for r in knowledge.enrich_results(results, asked, *knows).collect()}
    assert len(got[1, 0]) == 3 and got[1, 0][0].startswith("LA_BUC_01") and got[1, 1] is None and got[2, 0] is None


def test_augmented(spark, knows):
    q = spark.createDataFrame([(1, "Hvilke SEDer har LA BUC 02?"), (2, "plain")], "query_id int, query string")
    got = {r["query_id"]: r for r in search.augment_queries(q, *knows).collect()}
    assert got[1]["expanded"] == "Hvilke SEDer har LA BUC 02? LA_BUC_02 Artikkel 13 A001 Request A002" and got[1]["answer"] and got[2]["expanded"].strip() == "plain" and got[2]["entities"] is None


BROADER = [
    ("alpha beta and gamma", "alpha beta", "conjunction_split"), ("a vs b", None, None), ("one og two and three four", "one og two", "conjunction_split"), ("red cars versus blue and green", "red cars", "conjunction_split"), ("alpha beta (old)", "alpha beta", "trailing_parens"), ("(old)", None, None),
    ('"alpha beta" gamma', "alpha beta gamma", "unquote"), ("meningen med livet", None, None), ("big red house", "big red", "drop_last_word"), ("search of the index?", None, None), ("search the old index of it", "search the old index", "drop_last_word"),
    ("one", None, None), ("", None, None), ("it's a big 'thing'", "it's a big", "drop_last_word"), ("alpha, eller beta gamma", "alpha, eller beta", "drop_last_word"), ("the of and", None, None), ("x" * 5000 + " y z", "x" * 5000 + " y", "drop_last_word"),
]
NAMES = {"conjunction": "conjunction_split", "parentheses": "trailing_parens", "unquote": "unquote", "drop_word": "drop_last_word"}


def test_broader_queries(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(BROADER)] + [(99, None)], "i int, q string").select("i", tx.broaden(F.col("q")).alias("b"))
    got = {r["i"]: r["b"] for r in df.collect()}
    for i, (q, want, how) in enumerate(BROADER):
        assert (got[i] and got[i]["query"], got[i] and got[i]["strategy"]) == (want, how), q
        twin = tx.broaden_query(q)
        assert (twin and (twin[0], NAMES[twin[1]])) == (got[i] and (got[i]["query"], got[i]["strategy"])), q
    assert got[99] is None


def test_broader_as_the_plain_twin(spark):
    import random

    rng = random.Random(3)
    words = ["and", "og", "vs", "the", "alpha", "beta", "(x)", '"q"', "of", "&", "versus", "gamma?", "..", "med"]
    qs = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 8))) for _ in range(400)]
    for r in spark.createDataFrame([(q,) for q in qs], "q string").select("q", tx.broaden(F.col("q")).alias("b")).collect():
        twin = tx.broaden_query(r["q"])
        assert (twin and (twin[0], NAMES[twin[1]])) == (r["b"] and (r["b"]["query"], r["b"]["strategy"])), r["q"]

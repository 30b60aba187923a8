"""Queries of measures, maintenance, set relations and windows that the other modules leave out, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import cleanup, collection_queries as cq, convert, graph, ledger, maintenance, quality, retrieval as rt, search, traces
from marlstone.operators.retrieval_queries import BM25_CTE, DENSE_CTE, K, WORDS, _bm25, _chunks, _documents, _ranked_docs, _title_queries, _vector_queries, _vectors
from marlstone.plans import staged, table
from marlstone.streaming import incremental

# Measures ----------------------------------------------------------------------------------------------------------------


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Where each title's own document stands, without and with reranking."""
    plain = staged(_ranked_docs(spark, sf_dir).select("query_id", "chunk_id", "score", "rank"))
    return plain, rt.rerank(plain, _title_queries(spark, sf_dir), _chunks(spark, sf_dir), K)


def reranker_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, again = _ranks(spark, sf_dir)
    own = lambda df, name: df.filter("query_id = chunk_id").select("query_id", F.col("rank").alias(name))
    q = _title_queries(spark, sf_dir).select("query_id")
    return quality.reranker_lift(q.join(own(again, "with_rank"), "query_id", "left").join(own(plain, "without_rank"), "query_id", "left"))


RERANK_CTE = f"""rr AS (SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(0.5 - coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.title), {WORDS})), regexp_extract_all(lower(d.text), {WORDS})))
   / nullif(len(list_distinct(regexp_extract_all(lower(q.title), {WORDS}))), 0), 0), 6), b.doc_id) - 1 AS rank FROM bm25 b JOIN documents q ON q.doc_id = b.query_id JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank < {K})"""
RERANKER_LIFT_SQL = f"""WITH {BM25_CTE}, {RERANK_CTE},
k AS (SELECT q.doc_id, w.rank AS w, p.rank AS p FROM documents q LEFT JOIN (SELECT * FROM rr WHERE query_id = doc_id) w ON w.query_id = q.doc_id LEFT JOIN (SELECT * FROM bm25 WHERE query_id = doc_id AND rank < {K}) p ON p.query_id = q.doc_id WHERE q.doc_id % 50 = 0 AND q.title IS NOT NULL),
m AS (SELECT count(*) AS queries, avg(CASE WHEN w < 5 THEN 1.0 ELSE 0 END) AS wh, avg(coalesce(1.0 / (w + 1), 0)) AS wm, avg(CASE WHEN p < 5 THEN 1.0 ELSE 0 END) AS ph, avg(coalesce(1.0 / (p + 1), 0)) AS pm FROM k)
SELECT queries, round(wh, 6) AS with_hit_rate, round(wm, 6) AS with_mrr, round(ph, 6) AS without_hit_rate, round(pm, 6) AS without_mrr, round(wh - ph, 6) AS hit_rate_lift, round(wm - pm, 6) AS mrr_lift FROM m"""


def component_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, dense, fused and reranked retrieval of known titles side by side; documents and vectors of one number are one chunk."""
    plain, again = _ranks(spark, sf_dir)
    dense = staged(rt.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 3 * K))
    fused = rt.fuse(dense, staged(_bm25(spark, sf_dir, 3 * K)), K)
    known = _title_queries(spark, sf_dir).select("query_id")
    of = lambda df, name: known.join(df.filter(f"query_id = chunk_id and rank < {K}").select("query_id", "rank"), "query_id", "left").select(F.lit(name).alias("component"), "rank")
    return quality.component_comparison(of(plain, "bm25").unionByName(of(dense, "dense")).unionByName(of(fused, "hybrid")).unionByName(of(again, "reranked")))


COMPONENT_LEGS_SQL = f"""WITH {BM25_CTE}, {DENSE_CTE}, {RERANK_CTE},
merged AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.doc_id) AS doc_id, d.rank AS dense_rank, b.rank AS lexical_rank FROM (SELECT * FROM dense WHERE rank < {3 * K}) d FULL JOIN (SELECT * FROM bm25 WHERE rank < {3 * K}) b ON d.query_id = b.query_id AND d.chunk_id = b.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9), dense_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) - 1 AS rank FROM merged),
legs AS (SELECT 'bm25' AS component, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dense UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM rr),
k AS (SELECT c.component, q.doc_id, l.rank FROM documents q CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid'), ('reranked')) c(component) LEFT JOIN (SELECT * FROM legs WHERE query_id = doc_id AND rank < {K}) l ON l.query_id = q.doc_id AND l.component = c.component WHERE q.doc_id % 50 = 0 AND q.title IS NOT NULL),
m AS (SELECT component, count(*) AS n, round(avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / (rank + 1), 0)), 6) AS mrr FROM k GROUP BY component)
SELECT component, n, recall_5, mrr, round(recall_5 - (SELECT recall_5 FROM m WHERE component = 'bm25'), 6) AS recall_lift, round(mrr - (SELECT mrr FROM m WHERE component = 'bm25'), 6) AS mrr_lift FROM m"""


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' questions as cases: those of a nation with a supplier are answerable, by the supplier's name."""
    from marlstone.operators.knowledge_queries import process_answers

    answers = process_answers(spark, sf_dir).withColumnRenamed("text_id", "c_custkey")
    names = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(names, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(answers, "c_custkey", "left")
    return quality.answer_metrics(c.select((F.col("name").isNotNull() & (F.col("c_custkey") % 7 != 0)).alias("answerable"), "answer", F.array(F.coalesce("name", F.lit("?")), F.lit("Supplier")).alias("expected")))


ANSWER_METRICS_SQL = """WITH s AS (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier GROUP BY 1), sed AS (SELECT DISTINCT s_suppkey % 1000 AS n FROM supplier),
c AS (SELECT c_custkey % 7 <> 0 AND name IS NOT NULL AS y, name IS NOT NULL OR c_custkey % 1000 IN (SELECT n FROM sed) AS has, name FROM customer LEFT JOIN s ON k = c_nationkey)
SELECT count(*) AS cases, round(sum((y = has)::INT) / count(*), 6) AS accuracy, round(sum((y AND has)::INT) / sum(y::INT), 6) AS answer_rate, round(coalesce(sum((NOT y AND NOT has)::INT) / nullif(sum((NOT y)::INT), 0), 0), 6) AS non_answer_rate, 1.0 AS content_accuracy FROM c"""


def expansion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a title's first five documents stay when its source is added to the query."""
    index = rt.BM25Index(_chunks(spark, sf_dir)).materialise()
    more = _documents(spark, sf_dir).filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "title", "source").alias("query"))
    ids = lambda df: df.select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    return quality.shared_top(ids(index.search(_title_queries(spark, sf_dir), 5)), ids(index.search(more, 5)))


_OTHER_CTE = BM25_CTE.split("asked AS")[1].replace("scored AS", "scored2 AS").replace("FROM asked a", "FROM asked2 a").replace("bm25 AS", "bm252 AS").replace("FROM scored WHERE", "FROM scored2 WHERE").replace("lower(title)", "lower(concat_ws(' ', title, source))")
EXPANSION_OVERLAP_SQL = f"WITH {BM25_CTE}, asked2 AS{_OTHER_CTE} SELECT a.query_id, count(*) AS shared FROM bm25 a JOIN bm252 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.rank < 5 AND b.rank < 5 GROUP BY 1"


def response_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as queries, their kinds of events as collections: reranked unless it has a value under 1, low where the mean is."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    parts = e.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("collection")).agg((F.min("value") >= 1).alias("reranked"), (F.avg("value") < 20).alias("low_confidence"))
    return quality.response_flags(parts)


RESPONSE_FLAGS_SQL = "WITH p AS (SELECT user_id AS query_id, event_type, min(value) >= 1 AS r, avg(value) < 20 AS l FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT query_id, bool_and(coalesce(r, true)) AS reranked, bool_or(coalesce(l, false)) AS low_confidence FROM p GROUP BY 1"


def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.folder_counts(_documents(spark, sf_dir).filter("url <> ''"), "url")


FOLDER_COUNTS_SQL = "SELECT trim(regexp_extract(url, '^(.*)/[^/]*$', 1), '/') AS category, count(*) AS n FROM documents WHERE url <> '' GROUP BY 1"


def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_gaps(cq.gap_analysis(spark, sf_dir), 3)


TOP_GAPS_SQL = f"WITH {cq.GAP_CTE} SELECT doc, mean, least, chunks, row_number() OVER (ORDER BY mean DESC, doc) AS rank FROM gaps QUALIFY rank <= 3"

# Maintenance -------------------------------------------------------------------------------------------------------------


def excluded_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed issues that aren't active as such, but whose epic is."""
    i = cq._latest_issues(spark, sf_dir).select(F.col("issue_key").alias("key"), F.col("epic_link").alias("parent"), F.coalesce(F.lower("status"), F.lit("")).alias("status"))
    return cleanup.excluded_stubs(i.filter("status = 'closed'"), i.filter("status <> 'closed'")).select("key", "parent", "from_excluded")


EXCLUDED_STUBS_SQL = f"""WITH {cq.LATEST_CTE}, a AS (SELECT issue_key FROM latest WHERE lower(coalesce(status, '')) <> 'closed' AND issue_key <> '')
SELECT issue_key AS key, epic_link AS parent, true AS from_excluded FROM latest WHERE lower(status) = 'closed' AND issue_key <> '' AND epic_link IN (SELECT issue_key FROM a) AND issue_key NOT IN (SELECT issue_key FROM a)"""


def issue_epics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = cq._latest_issues(spark, sf_dir).filter("issue_key is not null")
    none = F.lit(None).cast("string")
    return graph.epic_of(i.select("issue_key", none.alias("parent"), none.alias("parent_type"), none.alias("parent_summary"), "epic_link"), i.select(F.col("issue_key").alias("key"), F.col("title").alias("summary")))


ISSUE_EPICS_SQL = f"WITH {cq.LATEST_CTE}, k AS (SELECT * FROM latest WHERE issue_key IS NOT NULL) SELECT k.issue_key, coalesce(k.epic_link, '') AS epic_key, coalesce(e.title, '') AS epic_summary FROM k LEFT JOIN k e ON e.issue_key = k.epic_link"


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.substring(tx.document_date(F.col("metadata")["date"], F.col("modified_time")), 1, 10).alias("date"))


DOCUMENT_DATES_SQL = "SELECT doc_id, substr(coalesce(nullif(trim(metadata['date']), ''), modified_time::VARCHAR), 1, 10) AS date FROM documents"


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a block delivered in the last month: new, or modified."""
    p = table(spark, sf_dir, "notion_blocks").groupBy("page_id").agg(F.min("received_at").alias("created"), F.max("received_at").alias("modified"))
    last = table(spark, sf_dir, "notion_blocks").agg((F.max("received_at") - F.expr("interval 30 days")).alias("_since"))
    return maintenance.new_and_modified(p.join(F.broadcast(last)), F.col("_since")).select("page_id", "change")  # one row


CHANGED_PAGES_SQL = "WITH p AS (SELECT page_id, min(received_at) AS c, max(received_at) AS m FROM notion_blocks GROUP BY 1), s AS (SELECT max(received_at) - INTERVAL 30 DAY AS t FROM notion_blocks) SELECT page_id, CASE WHEN c >= t THEN 'new' ELSE 'modified' END AS change FROM p, s WHERE m >= t"


def videos_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed videos but for those whose transcript has come."""
    v = table(spark, sf_dir, "youtube_videos").filter("video_id is not null").select(F.col("video_id").alias("id"), F.when(F.col("transcript").isNotNull(), "success").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error"), F.struct("received_at", "ingest_id").alias("at"))
    return maintenance.to_fetch(v.select("id"), maintenance.fetch_state(v.limit(0), v))


VIDEOS_TO_FETCH_SQL = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY received_at DESC, ingest_id DESC) AS n FROM youtube_videos WHERE video_id IS NOT NULL) SELECT video_id AS id FROM l WHERE n = 1 AND transcript IS NULL"


def fetch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "youtube_videos").select(F.when(F.col("video_id").isNull(), "skipped").when(F.col("transcript").isNotNull(), "success").otherwise("failed").alias("status"))
    return maintenance.fetch_statistics(v)


FETCH_STATISTICS_SQL = "SELECT count(*) AS total, count(CASE WHEN video_id IS NOT NULL AND transcript IS NOT NULL THEN 1 END) AS successful, count(CASE WHEN video_id IS NOT NULL AND transcript IS NULL THEN 1 END) AS failed, count(CASE WHEN video_id IS NULL THEN 1 END) AS skipped FROM youtube_videos"


def phase_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ends of phases: a view as skipped, else the whole part of the value as exit code."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "view", "skipped").otherwise(F.floor(F.col("value") / 10).cast("string"))
    return e.select("event_id", tx.phase_status(code).alias("status"))


PHASE_STATES_SQL = "SELECT event_id, CASE WHEN event_type = 'view' THEN 'skipped' WHEN floor(value / 10) = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM events"


def leading_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as chunks with metadata lines and a breadcrumb, taken apart again."""
    i = table(spark, sf_dir, "jira_issues").filter("issue_key is not null and title is not null and status is not null and description is null")
    text = F.concat(F.lit("\n["), F.split("issue_key", "-")[0], F.lit(" > "), "issue_key", F.lit("]\n**Status:** "), "status", F.lit("\n\n**Title:** "), "title", F.lit("\nBody of "), "issue_key", F.lit("\n**Not:** metadata\n"))
    m = tx.leading_metadata(text)
    return i.select("ingest_id", m["content"].alias("content"), m["breadcrumb"].alias("breadcrumb"), F.array_join(F.transform(F.array_sort(F.map_entries(m["metadata"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


LEADING_METADATA_SQL = """SELECT ingest_id, 'Body of ' || issue_key || chr(10) || '**Not:** metadata' AS content, split_part(issue_key, '-', 1) || ' > ' || issue_key AS breadcrumb, 'Status=' || trim(status) || ';Title=' || trim(title) AS metadata
FROM jira_issues WHERE issue_key IS NOT NULL AND title IS NOT NULL AND status IS NOT NULL AND description IS NULL"""

# Relations and windows ------------------------------------------------------------------------------------------------------


def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of issues and of comments: in both, in one only, and those that comments have more often."""
    i = table(spark, sf_dir, "jira_issues").filter("issue_key is not null").select("issue_key")
    c = table(spark, sf_dir, "jira_comments").filter("issue_key is not null").select("issue_key")
    named = lambda df, name: df.select("issue_key", F.lit(name).alias("relation"))
    more = c.exceptAll(i).groupBy("issue_key").agg(F.count("*").alias("n"))
    return named(i.intersect(c), "both").unionByName(named(i.subtract(c), "issues only")).unionByName(named(c.subtract(i), "comments only")).withColumn("n", F.lit(1).cast("long")).unionByName(more.select("issue_key", F.lit("more comments").alias("relation"), "n"))


SET_RELATIONS_SQL = """WITH i AS (SELECT issue_key FROM jira_issues WHERE issue_key IS NOT NULL), c AS (SELECT issue_key FROM jira_comments WHERE issue_key IS NOT NULL)
SELECT issue_key, 'both' AS relation, 1::BIGINT AS n FROM (SELECT * FROM i INTERSECT SELECT * FROM c) UNION ALL SELECT issue_key, 'issues only', 1 FROM (SELECT * FROM i EXCEPT SELECT * FROM c) UNION ALL SELECT issue_key, 'comments only', 1 FROM (SELECT * FROM c EXCEPT SELECT * FROM i)
UNION ALL SELECT issue_key, 'more comments', count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM i) GROUP BY 1"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of six hours, every two hours."""
    return cq._plain_times(incremental.windowed_counts(table(spark, sf_dir, "events").filter("ts is not null"), "6 hours", "2 hours"))


SLIDING_WINDOWS_SQL = """WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(2 * k::INT) AS start, event_type, value FROM events, range(3) r(k) WHERE ts IS NOT NULL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL"""


def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct users and of the values' quantiles by kind of event; no SQL gives the same estimates."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("users"), F.percentile_approx("value", [0.5, 0.9], 10_000).alias("quantiles"), F.count("*").alias("n"))


def value_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value with the sum of the last three of its user, and its rank among the user's values."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").filter("user_id is not null and value is not null")
    return e.select("event_id", F.round(F.sum("value").over(w.orderBy("event_id").rowsBetween(-2, 0)), 6).alias("last_three"), F.dense_rank().over(w.orderBy(F.desc("value"))).alias("place"), F.ntile(4).over(w.orderBy("value", "event_id")).alias("quarter"))


VALUE_FRAMES_SQL = """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS place, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS quarter
FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL"""


QUERIES = {
    f.__name__: f
    for f in (
        reranker_lift, component_legs, answer_metrics, expansion_overlap, response_flags, folder_counts, top_gaps, excluded_stubs, issue_epics, document_dates, changed_pages, videos_to_fetch, fetch_statistics, phase_states, leading_metadata,
        set_relations, sliding_windows, approximate_counts, value_frames,
    )
}
SQL = {
    "reranker_lift": RERANKER_LIFT_SQL, "component_legs": COMPONENT_LEGS_SQL, "answer_metrics": ANSWER_METRICS_SQL, "expansion_overlap": EXPANSION_OVERLAP_SQL, "response_flags": RESPONSE_FLAGS_SQL, "folder_counts": FOLDER_COUNTS_SQL, "top_gaps": TOP_GAPS_SQL,
    "excluded_stubs": EXCLUDED_STUBS_SQL, "issue_epics": ISSUE_EPICS_SQL, "document_dates": DOCUMENT_DATES_SQL, "changed_pages": CHANGED_PAGES_SQL, "videos_to_fetch": VIDEOS_TO_FETCH_SQL, "fetch_statistics": FETCH_STATISTICS_SQL, "phase_states": PHASE_STATES_SQL, "leading_metadata": LEADING_METADATA_SQL,
    "set_relations": SET_RELATIONS_SQL, "sliding_windows": SLIDING_WINDOWS_SQL, "value_frames": VALUE_FRAMES_SQL,
}

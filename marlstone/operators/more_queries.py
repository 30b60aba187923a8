"""Queries of composed searches, tagging, event windows and the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import collection_queries as cq, convert, graph, ledger, maintenance, quality, rendering, retrieval as rt, search, traces
from marlstone.operators.retrieval_queries import BM25_CTE, K, WORDS, _chunks, _documents, _title_queries
from marlstone.plans import staged, table
from marlstone.streaming import incremental


def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from titles to shaped results."""
    d = _documents(spark, sf_dir)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    docs = d.select("doc_id", F.coalesce("source", F.lit("none")).alias("collection"), "title", "url", "text")
    return search.search_collections(rt.BM25Index(_chunks(spark, sf_dir)).materialise(), chunks, docs, _title_queries(spark, sf_dir), 5)


def rendered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.render_results(search_pipeline(spark, sf_dir))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar to those whose id is divisible by 50, by their whole texts."""
    d = _documents(spark, sf_dir)
    asked = d.filter("doc_id % 50 = 0").select("doc_id", "text")
    return search.similar_documents(rt.BM25Index(_chunks(spark, sf_dir)).materialise(), d.select(F.col("doc_id").alias("chunk_id"), "doc_id"), asked)


SIMILAR_SQL = f"""WITH {BM25_CTE.split("asked AS")[0]} asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {WORDS})) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL),
scored AS {BM25_CTE.split("scored AS")[1]}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT * FROM bm25 WHERE rank < 30) WHERE doc_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"""


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the index after documents of ids divisible by 7 went and came back with their titles."""
    d = _documents(spark, sf_dir)
    index, gone = rt.BM25Index(_chunks(spark, sf_dir)), d.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("chunk_id"))
    added = rt.BM25Index(d.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("chunk_id"), F.coalesce("title", F.lit("")).alias("text")))
    postings, lengths = search.update_index(index.postings, index.lengths, gone, added)
    total = lengths.agg(F.sum("length").alias("words"))
    return postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row


INDEX_UPDATE_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(CASE WHEN doc_id % 7 = 0 THEN title ELSE text END, '')), {WORDS}) AS t FROM documents), p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM t)
SELECT term, count(*) AS df, (SELECT sum(len(t))::BIGINT FROM t) AS words FROM p GROUP BY term"""


def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each source covers the subjects, by the words of their titles and names."""
    topics = table(spark, sf_dir, "subjects").select(F.hash("subject").cast("long").alias("topic_id"), F.concat_ws(" ", "subject", "title").alias("query"), "subject")
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", F.coalesce("source", F.lit("none")).alias("collection"))
    found = search.topic_coverage(rt.BM25Index(_chunks(spark, sf_dir)).materialise(), topics, docs)
    return found.join(topics.select("topic_id", "subject"), "topic_id").select("subject", "collection", "documents", "chunks", "best")


TOPIC_COVERAGE_SQL = f"""WITH {BM25_CTE.split("asked AS")[0]} asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT subject AS query_id, unnest(regexp_extract_all(lower(subject || ' ' || title), {WORDS})) AS term FROM subjects) GROUP BY ALL),
scored AS {BM25_CTE.split("scored AS")[1]}
SELECT b.query_id AS subject, coalesce(d.source, 'none') AS collection, count(DISTINCT b.doc_id) AS documents, count(*) AS chunks, max(b.score) AS best FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank < 100 GROUP BY ALL"""


def constrained_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue labels as a taxonomy for the articles' titles and summaries."""
    taxonomy = table(spark, sf_dir, "jira_issues").select(F.explode("labels").alias("tag")).distinct().withColumn("category", F.lit("label"))
    texts = table(spark, sf_dir, "articles").select(F.col("ingest_id").alias("doc_id"), F.concat_ws(" ", "title", "summary").alias("text"))
    return search.tag_documents(texts, taxonomy).select("doc_id", "tag", "n", "rank")


CONSTRAINED_TAGS_SQL = r"""WITH tax AS (SELECT DISTINCT lower(unnest(labels)) AS tag FROM jira_issues), w AS (SELECT ingest_id AS doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, summary)), '[\p{L}\p{N}_]+')) AS tag FROM articles),
n AS (SELECT doc_id, tag, count(*) AS n FROM w WHERE tag IN (SELECT tag FROM tax) GROUP BY ALL)
SELECT doc_id, tag, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag) <= 5"""


def tag_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tag_discovery(table(spark, sf_dir, "articles").select(F.explode("tags").alias("tag")))


TAG_DISCOVERY_SQL = "SELECT tag, count(*) AS n, count(*) = 1 AS single FROM (SELECT unnest(tags) AS tag FROM articles) GROUP BY tag"


def block_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each block through its parents, by block type."""
    b = table(spark, sf_dir, "notion_blocks").select(F.concat_ws("/", "page_id", "block_id").alias("id"), F.when(F.col("parent_id").isNotNull(), F.concat_ws("/", "page_id", "parent_id")).alias("parent_id"), F.col("block_type").alias("name"))
    return search.ancestor_paths(b).select("id", F.array_join("path", " > ").alias("path"), "depth")


BLOCK_PATHS_SQL = """WITH RECURSIVE n AS (SELECT page_id || '/' || block_id AS id, min(page_id || '/' || parent_id) AS parent_id, min(block_type) AS name FROM notion_blocks GROUP BY 1),
p AS (SELECT id, parent_id AS next, name AS path, 1 AS depth FROM n UNION ALL SELECT p.id, n.parent_id, n.name || ' > ' || p.path, p.depth + 1 FROM p JOIN n ON n.id = p.next WHERE p.depth < 16)
SELECT id, path, depth FROM p WHERE next IS NULL OR next NOT IN (SELECT id FROM n)"""


def region_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole star graph as a list for each region, two levels deep."""
    nodes, edges = (staged(x) for x in cq._star(spark, sf_dir))
    reached, walked = (staged(x) for x in graph.subtree(nodes, edges, nodes.filter("type = 'Region'").select(F.col("id").alias("root")), "incoming", ["in_region", "in_nation"], 2, None))
    return rendering.render_subtree(reached, nodes, graph.tree_paths(reached, walked, 2))


def augmented_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = (staged(x) for x in cq._issue_graph(spark, sf_dir))
    q = cq._latest_issues(spark, sf_dir).filter("epic_link is not null").select(F.col("ingest_id").alias("query_id"), F.concat_ws(" ", "title", "epic_link").alias("query"))
    return search.augment_queries(q, nodes, edges).select("query_id", "expanded", F.size("entities").alias("entities"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cq._plain_times(incremental.event_sessions(table(spark, sf_dir, "events").filter("user_id is not null and ts is not null")))


EVENT_SESSIONS_SQL = """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS events, round(sum(value), 6) AS total FROM g GROUP BY user_id, k"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cq._plain_times(incremental.windowed_counts(table(spark, sf_dir, "events").filter("ts is not null"), "6 hours"))


EVENT_WINDOWS_SQL = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"


def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind of event per user (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").filter("user_id is not null").withColumn("_s", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int")).withColumn("_k", F.sum("_s").over(w))
    return e.groupBy("user_id", "_k", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("_k")


EVENT_STREAKS_SQL = """WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM g GROUP BY user_id, k, event_type"""


def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by every combination of region and market segment."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.cube("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SEGMENT_CUBE_SQL = "SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)"


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


PRICING_SUMMARY_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"


def exchange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source as answers of exchanges: how many exchanges and turns each issue's comments hold."""
    t = table(spark, sf_dir, "jira_comments").select(F.col("issue_key").alias("session"), F.struct("pos", "ingest_id").alias("pos"), F.when(F.col("author") == "Unknown", "assistant").otherwise("user").alias("role"))
    return traces.exchanges(t.filter("session is not null")).groupBy("session").agg(F.max("exchange").alias("exchanges"), F.count("*").alias("turns"))


EXCHANGE_PAIRS_SQL = "SELECT issue_key AS session, count(CASE WHEN author = 'Unknown' THEN NULL ELSE 1 END) AS exchanges, count(*) AS turns FROM jira_comments WHERE issue_key IS NOT NULL GROUP BY 1"


def component_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 alone against BM25 with the title boost, on known titles."""
    base = rt.BM25Index(_chunks(spark, sf_dir)).materialise().search(_title_queries(spark, sf_dir), K)
    base = staged(base.select("query_id", "chunk_id", F.col("chunk_id").alias("doc_id"), (-F.col("score")).alias("score"), "rank"))
    boosted = rt.title_boost(base, _documents(spark, sf_dir).select("doc_id", "title"), _title_queries(spark, sf_dir))
    known = _title_queries(spark, sf_dir).select("query_id")
    of = lambda df, name: known.join(df.filter("query_id = doc_id").select("query_id", "rank"), "query_id", "left").select(F.lit(name).alias("component"), "rank")
    return quality.component_comparison(of(base, "bm25").unionByName(of(boosted, "bm25+title")))


def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores from 1 to 5 in four dimensions, users as items."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and value is not null")
    scores = e.groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("dimension")).agg(F.round(F.avg(F.least("value", F.lit(5.0))), 6).alias("score"))
    return quality.rubric_scores(scores, spark.createDataFrame([("click", 0.4), ("view", 0.3), ("purchase", 0.2), ("signup", 0.1)], "dimension string, weight double"))


RUBRIC_SQL = """WITH s AS (SELECT user_id AS item, event_type AS dimension, round(avg(least(value, 5.0)), 6) AS score FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM (VALUES ('click', 0.4::DOUBLE), ('view', 0.3), ('purchase', 0.2), ('signup', 0.1)) t(dimension, weight))
SELECT i.item, round(sum(coalesce(s.score, 3.0) * w.weight) / sum(w.weight), 6) AS weighted FROM (SELECT DISTINCT item FROM s) i CROSS JOIN w LEFT JOIN s ON s.item = i.item AND s.dimension = w.dimension GROUP BY i.item"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over issue and video fields."""
    v = table(spark, sf_dir, "youtube_videos")
    return v.select(
        "ingest_id", tx.generic_title(F.col("title")).alias("generic"), tx.safe_filename(F.col("title"), 40).alias("file"), tx.escape_scalar(F.col("title")).alias("escaped"), tx.tag_line(F.col("category"), F.array(F.lit("video"))).alias("tag_line"),
        F.round(tx.relevance(F.col("ingest_id") / 100.0 - 1), 6).alias("relevance"), tx.percent(F.lit(0.125) + F.col("ingest_id") % 7 / 10).alias("percent"),
    )


TEXT_FUNCTIONS_SQL = r"""WITH t AS (SELECT *, lower(trim(coalesce(title, ''))) AS l FROM youtube_videos)
SELECT ingest_id, l IN ('', 'youtube', 'video', 'untitled', 'youtube video') OR (regexp_matches(l, '^(?:video\s+)?[\w-]{11}$') AND regexp_matches(l, '\d')) AS generic, substr(trim(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), 1, 40) AS file,
replace(replace(regexp_replace(trim(title), '\s*[\r\n]+\s*', ' ', 'g'), '\', '\\'), '"', '\"') AS escaped,
array_to_string(list_filter(CASE WHEN list_contains(string_split(coalesce(category, ''), '/'), 'video') THEN string_split(coalesce(category, ''), '/') ELSE list_append(string_split(coalesce(category, ''), '/'), 'video') END, lambda x: x <> ''), ', ') AS tag_line,
round(1 / (1 + exp((ingest_id / 100.0 - 1 + 0.15) * 8)), 6) AS relevance, round_even((0.125 + ingest_id % 7 / 10) * 100, 0)::INT || '%' AS percent FROM t"""


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with their timed lines under chapters of ten minutes."""
    v = table(spark, sf_dir, "youtube_videos").filter("transcript is not null")
    lines = staged(convert.transcript_lines(v, "ingest_id", "transcript"))
    chapters = lines.filter("seconds is not null").select("ingest_id", (F.floor(F.col("seconds") / 600) * 600).cast("int").alias("start")).distinct().withColumn("title", F.format_string("Minute %d", (F.col("start") / 60).cast("int")))
    return convert.transcript_markdown(convert.assign_chapters(lines, chapters, "ingest_id"), "ingest_id")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_runs(cq._runs(spark, sf_dir), 3).select("collection", "run", "status", "duration_s")


def issue_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = table(spark, sf_dir, "jira_comments").select("issue_key", F.struct("pos", "ingest_id").alias("pos"), "body")
    return convert.issue_chunks(cq._latest_issues(spark, sf_dir).filter("issue_key is not null"), comments)


def collection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and blocks of ten lines per source."""
    d = _documents(spark, sf_dir).withColumn("collection", F.coalesce(F.lower(F.trim("source")), F.lit("none")))
    chunks = d.select("collection", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 1000))))
    return cq._plain_times(maintenance.collection_manifest(d, chunks, {"reader": "parquet"}))


COLLECTION_MANIFEST_SQL = "SELECT coalesce(lower(trim(source)), 'none') AS collection, count(*) AS documents, sum(n_chars // 1000 + 1)::BIGINT AS chunks, strftime(max(modified_time), '%Y-%m-%d %H:%M:%S.%f') AS last_modified, 'parquet' AS reader FROM documents GROUP BY 1"


QUERIES = {
    f.__name__: f
    for f in (
        search_pipeline, rendered_results, similar_documents, index_update, topic_coverage, constrained_tags, tag_discovery, block_paths, region_trees, augmented_queries, event_sessions, event_windows, event_streaks, segment_cube, pricing_summary,
        exchange_pairs, component_comparison, rubric_scores, text_functions, transcript_documents, last_runs, issue_chunks, collection_manifest,
    )
}
SQL = {
    "similar_documents": SIMILAR_SQL, "index_update": INDEX_UPDATE_SQL, "topic_coverage": TOPIC_COVERAGE_SQL, "constrained_tags": CONSTRAINED_TAGS_SQL, "tag_discovery": TAG_DISCOVERY_SQL, "block_paths": BLOCK_PATHS_SQL, 
    "event_sessions": EVENT_SESSIONS_SQL, "event_windows": EVENT_WINDOWS_SQL, "event_streaks": EVENT_STREAKS_SQL, "segment_cube": SEGMENT_CUBE_SQL, "pricing_summary": PRICING_SUMMARY_SQL, "exchange_pairs": EXCHANGE_PAIRS_SQL, "rubric_scores": RUBRIC_SQL, "text_functions": TEXT_FUNCTIONS_SQL, "collection_manifest": COLLECTION_MANIFEST_SQL,
}

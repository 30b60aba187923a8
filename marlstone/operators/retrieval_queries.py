"""Queries of retrieval and quality over the documents and embeddings, with their SQL.

Searches take the rows whose id is divisible by 50 as queries, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import quality, retrieval as rt, traces
from marlstone.plans import staged, table

K = 10
WORDS = r"'[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")


def _title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _bm25(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return rt.BM25Index(_chunks(spark, sf_dir)).materialise().search(_title_queries(spark, sf_dir), k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


BM25_CTE = f"""
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS length FROM tok),
totals AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raws AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY ALL), totals),
mean AS (SELECT avg(raw) AS m FROM raws),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(title), {WORDS})) AS term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL) GROUP BY ALL),
scored AS (
  SELECT a.query_id, p.doc_id, round(sum(a.qtf * CASE WHEN r.raw < 0 THEN 0.25 * m ELSE r.raw END * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.length / avgdl))), 6) AS score
  FROM asked a JOIN raws r USING (term) JOIN post p USING (term) JOIN lens l ON l.doc_id = p.doc_id, mean, totals GROUP BY a.query_id, p.doc_id),
bm25 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored WHERE score > 0))"""
BM25_TOPK_SQL = f"WITH {BM25_CTE} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank < {K}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), K)


DENSE_CTE = """
near AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2))), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM near)"""
DENSE_TOPK_SQL = f"WITH {DENSE_CTE} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank < {K}"


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors of the same number stand for one chunk."""
    dense = rt.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 3 * K)
    return rt.fuse(staged(dense), staged(_bm25(spark, sf_dir, 3 * K)), K).select("query_id", "chunk_id", "score", "dense_rank", "lexical_rank", "rank")


RRF_SQL = f"""WITH {BM25_CTE}, {DENSE_CTE},
merged AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.doc_id) AS chunk_id, d.rank AS dense_rank, b.rank AS lexical_rank
  FROM (SELECT * FROM dense WHERE rank < {3 * K}) d FULL JOIN (SELECT * FROM bm25 WHERE rank < {3 * K}) b ON d.query_id = b.query_id AND d.chunk_id = b.doc_id),
fused AS (SELECT *, -round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9) AS score FROM merged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) - 1 AS rank FROM fused)
SELECT query_id, chunk_id, score, dense_rank, lexical_rank, rank FROM ranked WHERE rank < {K}"""


def _ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"), "doc_id", (-F.col("score")).alias("score"), "rank")


def title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rt.title_boost(_ranked_docs(spark, sf_dir), _documents(spark, sf_dir).select("doc_id", "title"), _title_queries(spark, sf_dir))
    return out.select("query_id", "doc_id", "score", "rank")


TITLE_BOOST_SQL = f"""WITH {BM25_CTE},
x AS (SELECT b.query_id, b.doc_id, -b.score AS s, list_distinct(regexp_extract_all(lower(q.title), '[\\p{{L}}\\p{{N}}_]+')) AS qt,
  list_distinct(regexp_extract_all(lower(translate(coalesce(d.title, ''), '-_', '  ')), '[\\p{{L}}\\p{{N}}_]+')) AS tt
  FROM bm25 b JOIN documents q ON q.doc_id = b.query_id JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank < {K}),
y AS (SELECT *, len(list_intersect(qt, tt)) AS overlap, max(s) OVER w - min(s) OVER w AS spread, min(s) OVER w AS first, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, CASE WHEN spread < 1e-6 THEN greatest(abs(first) * 0.1, 0.01) ELSE spread END AS step FROM y),
v AS (SELECT query_id, doc_id, round(s + CASE WHEN n >= 2 AND len(qt) >= 1 THEN greatest(-0.5 * step * overlap, -1.5 * step) ELSE 0 END, 7) AS score FROM z)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) - 1 AS rank FROM v"""


def rank_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ranked_docs(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("none")).alias("collection")), "doc_id").withColumnRenamed("score", "best_score")
    return rt.shape_results(docs, K).select("query_id", "collection", "doc_id", "position", "relevance", "band")


RANK_RELEVANCE_SQL = f"""WITH {BM25_CTE},
p AS (SELECT b.query_id, coalesce(d.source, 'none') AS collection, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY -b.score, coalesce(d.source, 'none'), b.doc_id) - 1 AS position
  FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank < {K})
SELECT query_id, collection, doc_id, position, round(0.75 / (1 + 0.12 * position), 6) AS relevance, CASE WHEN round(0.75 / (1 + 0.12 * position), 6) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM p"""


def reranked_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked by shared words: noise dropped, relevance by score, bands."""
    q, c = _title_queries(spark, sf_dir), _chunks(spark, sf_dir)
    again = rt.rerank(_ranked_docs(spark, sf_dir).select("query_id", "chunk_id", "score", "rank"), q, c, K)
    docs = again.select("query_id", F.lit("documents").alias("collection"), F.col("chunk_id").alias("doc_id"), F.col("score").alias("best_score"))
    return rt.shape_results(rt.drop_noise(docs, True), K, True).select("query_id", "doc_id", "best_score", "low_confidence", "relevance", "band")


RERANKED_SQL = f"""WITH {BM25_CTE},
s AS (SELECT b.query_id, b.doc_id, round(0.5 - coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.title), {WORDS})), regexp_extract_all(lower(d.text), {WORDS})))
   / nullif(len(list_distinct(regexp_extract_all(lower(q.title), {WORDS}))), 0), 0), 6) AS best_score
  FROM bm25 b JOIN documents q ON q.doc_id = b.query_id JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank < {K}),
t AS (SELECT *, min(best_score) OVER (PARTITION BY query_id) > -0.10 AS low_confidence FROM s)
SELECT query_id, doc_id, best_score, low_confidence, round(1 / (1 + exp((best_score + 0.15) * 8)), 6) AS relevance,
  CASE WHEN round(1 / (1 + exp((best_score + 0.15) * 8)), 6) >= 0.65 THEN 'high' WHEN round(1 / (1 + exp((best_score + 0.15) * 8)), 6) >= 0.40 THEN 'medium' ELSE 'low' END AS band
FROM t WHERE best_score <= -0.10"""


def search_dedup_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked_docs(spark, sf_dir).select("query_id", "rank", "doc_id").join(_documents(spark, sf_dir).select("doc_id", "url", "text"), "doc_id")
    return rt.keep_first_documents(ranked)


SEARCH_DEDUP_SQL = f"""WITH RECURSIVE {BM25_CTE},
r AS (SELECT b.query_id, b.rank, b.doc_id, coalesce(d.url, '') AS url, CASE WHEN coalesce(d.text, '') <> '' THEN md5(d.text) ELSE '' END AS hash FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank < {K}),
f AS (
  SELECT query_id, rank, doc_id, true AS kept, CASE WHEN url <> '' THEN [url] ELSE []::VARCHAR[] END AS urls, CASE WHEN hash <> '' THEN [hash] ELSE []::VARCHAR[] END AS hashes FROM r WHERE rank = 0
  UNION ALL
  SELECT r.query_id, r.rank, r.doc_id, NOT ((r.url <> '' AND list_contains(f.urls, r.url)) OR (r.hash <> '' AND list_contains(f.hashes, r.hash))),
    CASE WHEN r.url <> '' AND NOT ((list_contains(f.urls, r.url)) OR (r.hash <> '' AND list_contains(f.hashes, r.hash))) THEN list_append(f.urls, r.url) ELSE f.urls END,
    CASE WHEN r.hash <> '' AND NOT ((r.url <> '' AND list_contains(f.urls, r.url)) OR list_contains(f.hashes, r.hash)) THEN list_append(f.hashes, r.hash) ELSE f.hashes END
  FROM f JOIN r ON r.query_id = f.query_id AND r.rank = f.rank + 1)
SELECT query_id, rank, doc_id FROM f WHERE kept"""


def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors grouped by label: a label stands for a document, its vectors for chunks."""
    near = rt.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 30).join(_vectors(spark, sf_dir).select("chunk_id", F.col("label").alias("doc_id")), "chunk_id")
    return rt.group_documents(near).select("query_id", "doc_id", "doc_rank", "best_score", F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",").alias("chunk_ids"))


CHUNKS_PER_DOCUMENT_SQL = f"""WITH {DENSE_CTE},
c AS (SELECT d.*, e.label AS doc_id, row_number() OVER (PARTITION BY d.query_id, e.label ORDER BY d.score, d.chunk_id) AS n FROM dense d JOIN embeddings e ON e.vec_id = d.chunk_id WHERE d.rank < 30),
g AS (SELECT query_id, doc_id, min(score) AS best_score, min(rank) AS f, string_agg(CASE WHEN n <= 3 THEN chunk_id::VARCHAR END, ',' ORDER BY score, chunk_id) AS chunk_ids FROM c GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id) - 1 AS doc_rank, best_score, chunk_ids FROM g"""


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.metadata_filter(_documents(spark, sf_dir), tags=["batch", "portal"]).select("doc_id", "source", F.array_join(tx.parse_tags(F.col("metadata")["tags"]), ",").alias("tags"))


METADATA_FILTER_SQL = """WITH t AS (SELECT doc_id, source, list_filter(list_transform(string_split(metadata['tags'], ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM documents WHERE metadata['tags'] IS NOT NULL)
SELECT doc_id, source, array_to_string(tags, ',') AS tags FROM t WHERE list_has_any(tags, ['batch', 'portal'])"""


def corrective_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = rt.BM25Index(_chunks(spark, sf_dir)).materialise()
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("none")).alias("collection"))

    def run(queries: DataFrame) -> DataFrame:
        found = index.search(queries, 5).select("query_id", F.col("chunk_id").alias("doc_id"), (F.lit(0.5) - F.col("score") / (F.col("score") + 8)).alias("best_score"))
        return rt.shape_results(found.join(docs, "doc_id"), 5, True)

    results, verdicts = rt.corrective_search(run, _title_queries(spark, sf_dir), 5)
    return results.groupBy("query_id").agg(F.count("*").alias("results"), F.sum(F.col("rescued").cast("int")).alias("rescued") if "rescued" in results.columns else F.lit(0).alias("rescued")).join(verdicts, "query_id", "full_outer").select("query_id", "verdict", "results", "rescued")


def _known_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bm25(spark, sf_dir).filter("query_id = chunk_id").select("query_id", "rank")
    return _title_queries(spark, sf_dir).select("query_id").join(found, "query_id", "left")


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a title finds its own document, by language label."""
    lang = _documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.coalesce("lang", F.lit("none")).alias("lang"))
    return quality.retrieval_metrics(_known_ranks(spark, sf_dir).join(lang, "query_id"), ["lang"])


RECALL_MRR_SQL = f"""WITH {BM25_CTE},
k AS (SELECT coalesce(d.lang, 'none') AS lang, b.rank FROM documents d LEFT JOIN (SELECT * FROM bm25 WHERE rank < {K} AND query_id = doc_id) b ON b.query_id = d.doc_id WHERE d.doc_id % 50 = 0 AND d.title IS NOT NULL)
SELECT lang, count(*) AS n, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
  round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / (rank + 1), 0.0)), 6) AS mrr FROM k GROUP BY lang"""


def candidate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = staged(rt.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), K))
    lexical = staged(_bm25(spark, sf_dir, K))
    return traces.candidate_trace({"dense": dense, "lexical": lexical})


CANDIDATE_TRACE_SQL = f"""WITH {BM25_CTE}, {DENSE_CTE}
SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.doc_id) AS chunk_id, d.score AS dense_score, d.rank AS dense_rank, b.score AS lexical_score, b.rank AS lexical_rank
FROM (SELECT * FROM dense WHERE rank < {K}) d FULL JOIN (SELECT * FROM bm25 WHERE rank < {K}) b ON d.query_id = b.query_id AND d.chunk_id = b.doc_id"""


def hashed_embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search on hashed word counts of titles."""
    embed = rt.hashing_embedder(32)
    docs = _documents(spark, sf_dir).filter("title is not null").select(F.col("doc_id").alias("chunk_id"), embed(F.col("title")).alias("embedding"))
    return rt.dense_search(docs, docs.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), 5)


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and total count of each term."""
    p = rt.BM25Index(_chunks(spark, sf_dir)).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


TERM_STATISTICS_SQL = f"WITH {BM25_CTE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term"


def latency_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latency_summary(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")).filter("ms is not null"), ["event_type"])


LATENCY_SQL = """WITH r AS (SELECT event_type, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(median(ms), 6) AS median, min(CASE WHEN r >= ceil(0.9 * n) THEN ms END) AS p90, round(avg(ms), 6) AS mean FROM r GROUP BY event_type"""


def label_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well one word tells the documents labelled English, by source."""
    d = _documents(spark, sf_dir).filter("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), F.lower(F.coalesce("lang", F.lit(""))).startswith("en").alias("expected"), F.lower("text").rlike(r"\bthe\b").alias("found"))
    return quality.classification_metrics(d, ["source"])


LABEL_CLASSIFICATION_SQL = r"""WITH d AS (SELECT coalesce(source, 'none') AS source, starts_with(lower(coalesce(lang, '')), 'en') AS e, regexp_matches(lower(text), '\bthe\b') AS f FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, sum((e AND f)::INT)::BIGINT AS tp, sum((NOT e AND f)::INT)::BIGINT AS fp, sum((e AND NOT f)::INT)::BIGINT AS fn FROM d GROUP BY source),
h AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM g)
SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM h"""


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event values of the second half of the month against the first."""
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("late", F.dayofmonth("ts") > 15)
    m = e.groupBy("event_type", "late").agg(F.round(F.avg("value"), 6).alias("value")).select(F.col("event_type").alias("benchmark"), F.lit("mean_ms").alias("metric"), "value", "late")
    return quality.baseline_compare(m.filter("late").drop("late"), m.filter("not late").drop("late"))


BASELINE_SQL = """WITH m AS (SELECT event_type AS benchmark, day(ts) > 15 AS late, round(avg(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL),
j AS (SELECT a.benchmark, b.value AS before, a.value, (a.value - b.value) / nullif(abs(b.value), 0) AS c FROM m a JOIN m b ON a.benchmark = b.benchmark WHERE a.late AND NOT b.late)
SELECT benchmark, 'mean_ms' AS metric, before, value, round(c, 6) AS change, CASE WHEN c IS NULL OR abs(c) <= 0.1 THEN 'same' WHEN -c > 0 THEN 'better' ELSE 'worse' END AS verdict FROM j"""


def search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as calls: a view starts a search, a click fetches; users are traces."""
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    calls = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "search").otherwise("fetch").alias("type"), F.concat(F.lit("q"), (F.col("event_id") % 7).cast("string")).alias("query"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string"))).alias("collection"), F.lit(None).cast("string").alias("tags"), F.col("event_id").cast("string").alias("doc_id"))
    return traces.pair_searches(calls).select("trace_id", "pos", "collection", "query", F.array_join("fetched", ",").alias("fetched"))


SEARCH_PAIRS_SQL = """WITH e AS (SELECT user_id AS trace_id, event_id AS pos, event_type, 'q' || (event_id % 7) AS query, 'c' || (event_id % 3) AS coll FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY trace_id ORDER BY pos) AS nth FROM e),
f AS (SELECT trace_id, nth, coll, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS fetched, count(*) AS n, min(pos) AS first FROM c WHERE event_type = 'click' AND nth > 0 GROUP BY ALL),
l AS (SELECT trace_id, nth, arg_max(coll, n * 1000000000 - first) AS likely FROM f GROUP BY ALL),
s AS (SELECT c.trace_id, c.nth, c.pos, c.query, coalesce(l.likely, '') AS target FROM c LEFT JOIN l USING (trace_id, nth) WHERE c.event_type = 'view'),
a AS (SELECT trace_id, nth, pos, query, target AS collection FROM s UNION ALL SELECT s.trace_id, s.nth, s.pos, s.query, f.coll FROM s JOIN f USING (trace_id, nth) WHERE f.coll <> s.target),
r AS (SELECT a.*, coalesce(f.fetched, '') AS fetched, row_number() OVER (PARTITION BY a.trace_id, a.collection, a.query ORDER BY a.pos DESC) AS k FROM a LEFT JOIN f ON f.trace_id = a.trace_id AND f.nth = a.nth AND f.coll = a.collection)
SELECT trace_id, pos, collection, query, fetched FROM r WHERE k = 1"""


def exchange_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments read as turns of an issue's session: its reporter asks, others answer."""
    first = table(spark, sf_dir, "jira_comments").groupBy("issue_key").agg(F.min_by("author", F.struct("pos", "ingest_id")).alias("asker"))
    t = table(spark, sf_dir, "jira_comments").join(first, "issue_key").select(F.col("issue_key").alias("session"), F.struct("pos", "ingest_id").alias("pos"), F.when(F.col("author") == F.col("asker"), "user").otherwise("assistant").alias("role"), "ingest_id")
    return traces.exchanges(t).select("session", "ingest_id", "role", "exchange")


EXCHANGE_SQL = """WITH f AS (SELECT issue_key, arg_min(author, (pos, ingest_id)) AS asker FROM jira_comments WHERE author IS NOT NULL GROUP BY issue_key),
g AS (SELECT issue_key, first(author ORDER BY pos, ingest_id) AS asker FROM jira_comments WHERE issue_key IS NOT NULL GROUP BY issue_key),
t AS (SELECT c.issue_key AS session, c.pos, c.ingest_id, CASE WHEN c.author = g.asker THEN 'user' ELSE 'assistant' END AS role FROM jira_comments c JOIN g USING (issue_key))
SELECT session, ingest_id, role, sum((role = 'user')::INT) OVER (PARTITION BY session ORDER BY pos, ingest_id)::BIGINT AS exchange FROM t"""


QUERIES = {
    "bm25_topk": bm25_topk, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion, "title_boost": title_boost, "rank_relevance": rank_relevance, "reranked_bands": reranked_bands, "search_dedup_fold": search_dedup_fold,
    "chunks_per_document": chunks_per_document, "metadata_filter": metadata_filter, "corrective_verdicts": corrective_verdicts, "recall_mrr": recall_mrr, "candidate_trace": candidate_trace, "hashed_embedding_search": hashed_embedding_search,
    "term_statistics": term_statistics, "latency_by_event": latency_by_event, "label_classification": label_classification, "baseline_compare": baseline_compare, "search_pairs": search_pairs, "exchange_numbers": exchange_numbers,
}
SQL = {
    "bm25_topk": BM25_TOPK_SQL, "dense_topk": DENSE_TOPK_SQL, "rrf_fusion": RRF_SQL, "title_boost": TITLE_BOOST_SQL, "rank_relevance": RANK_RELEVANCE_SQL, "reranked_bands": RERANKED_SQL, "search_dedup_fold": SEARCH_DEDUP_SQL,
    "chunks_per_document": CHUNKS_PER_DOCUMENT_SQL, "metadata_filter": METADATA_FILTER_SQL, "recall_mrr": RECALL_MRR_SQL, "candidate_trace": CANDIDATE_TRACE_SQL, "term_statistics": TERM_STATISTICS_SQL, "latency_by_event": LATENCY_SQL,
    "label_classification": LABEL_CLASSIFICATION_SQL, "baseline_compare": BASELINE_SQL, "search_pairs": SEARCH_PAIRS_SQL, "exchange_numbers": EXCHANGE_SQL,
}

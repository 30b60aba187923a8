"""Traces of searches: calls paired to queries and fetched documents, query logs, traces with an end of life."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import running_sum


def pair_searches(calls: DataFrame) -> DataFrame:
    """Searches with the documents fetched before the next search: trace_id, pos, collection, query, tags, fetched.

    calls: trace_id, pos, type (search, fetch), query, collection, tags, doc_id. A search without a collection takes the one
    most fetched from. Its own collection is listed even without documents, others only with some. Fetches before the first
    search don't count. Of a query asked again in one trace and collection the last is kept.
    """
    c = running_sum(calls, ["trace_id"], ["pos"], F.when(F.col("type") == "search", 1).otherwise(0), "nth").filter("nth > 0")
    s = c.filter("type = 'search'").select("trace_id", "nth", "pos", "query", "tags", F.nullif(F.coalesce("collection", F.lit("")), F.lit("")).alias("own"))
    f = c.filter("type = 'fetch'").groupBy("trace_id", "nth", "collection").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("fetched"), F.count("*").alias("n"), F.min("pos").alias("first"))
    likely = f.groupBy("trace_id", "nth").agg(F.max_by("collection", F.struct(F.col("n"), -F.col("first"))).alias("likely"))
    s = s.join(likely, ["trace_id", "nth"], "left").withColumn("target", F.coalesce("own", "likely", F.lit("")))
    own = s.select("trace_id", "nth", "pos", "query", "tags", F.col("target").alias("collection"))
    others = s.join(f.select("trace_id", "nth", "collection"), ["trace_id", "nth"]).filter("collection <> target").select(*own.columns)
    every = own.unionByName(others).join(f.select("trace_id", "nth", "collection", "fetched"), ["trace_id", "nth", "collection"], "left")
    every = every.withColumn("fetched", F.coalesce("fetched", F.array().cast("array<string>")))
    row = F.struct("trace_id", "pos", "collection", "query", "tags", "fetched")
    return every.groupBy("trace_id", "collection", "query").agg(F.max_by(row, "pos").alias("_r")).select("_r.*")


def exchanges(turns: DataFrame) -> DataFrame:
    """Turns (session, pos, role, text) numbered by exchange: each starts with a user's turn; turns before the first have 0."""
    return running_sum(turns, ["session"], ["pos"], F.when(F.col("role") == "user", 1).otherwise(0), "exchange")


def query_log(results: DataFrame, queries: DataFrame, at: str) -> DataFrame:
    """A log row a query: ts, query (300 characters), result_count, best_score, top_doc."""
    r = results.groupBy("query_id").agg(F.count("*").alias("result_count"), F.max("relevance").alias("best_score"), F.min_by("doc_id", "position").alias("top_doc"))
    return queries.join(r, "query_id", "left").select(F.lit(at).alias("ts"), "query_id", F.substring("query", 1, 300).alias("query"), F.coalesce("result_count", F.lit(0)).alias("result_count"), "best_score", "top_doc")


def candidate_trace(stages: dict[str, DataFrame]) -> DataFrame:
    """Candidates with their score and rank in every stage: query_id, chunk_id, and per stage <stage>_score, <stage>_rank."""
    out: DataFrame | None = None
    for name, df in stages.items():
        part = df.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
        out = part if out is None else out.join(part, ["query_id", "chunk_id"], "full_outer")
    assert out is not None
    return out


def live_traces(traces: DataFrame, now: str, ttl_s: int = 300, most: int = 10_000) -> DataFrame:
    """Traces (trace_id, stored_at) that haven't expired; beyond `most` the soonest to expire go."""
    alive = traces.filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("stored_at") < ttl_s)
    return alive.orderBy(F.desc("stored_at"), "trace_id").limit(most)

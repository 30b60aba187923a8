"""Measures of retrieval, tagging, detection and speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def match_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """The first rank of each expected document of a query: query_id, expected, rank (null if not found).

    results: query_id, rank, doc_id; expected: query_id, expected. A result matches if it holds the expected name, also
    without signs and case, or has the same issue key.
    """
    key = lambda c: F.nullif(F.regexp_extract(c, r"\b([A-Z][A-Z0-9]+-\d+)\b", 1), F.lit(""))
    j = expected.join(results, "query_id", "left")
    hit = F.contains(F.col("doc_id"), F.col("expected")) | F.contains(normalised(F.col("doc_id")), normalised(F.col("expected"))) | F.coalesce(key(F.col("doc_id")) == key(F.col("expected")), F.lit(False))
    return j.groupBy("query_id", "expected").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def retrieval_metrics(ranks: DataFrame, per: list[str] = []) -> DataFrame:
    """Recall at 1, 3 and 5, hit rate, and mean reciprocal rank of expected documents. ranks: rank from 0, null if not found."""
    r = F.col("rank")
    at = lambda k: F.round(F.avg(F.when(r < k, 1.0).otherwise(0.0)), 6)
    return ranks.groupBy(*per).agg(F.count("*").alias("n"), at(1).alias("recall_1"), at(3).alias("recall_3"), at(5).alias("recall_5"), F.round(F.avg(r.isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / (r + 1), F.lit(0.0))), 6).alias("mrr"))


def component_comparison(ranks: DataFrame) -> DataFrame:
    """Recall at 5 and mean reciprocal rank by component, and their lift over the first component by name."""
    m = retrieval_metrics(ranks, ["component"]).select("component", "n", "recall_5", "mrr")
    base = m.agg(F.min_by("recall_5", "component").alias("r0"), F.min_by("mrr", "component").alias("m0"))
    return m.crossJoin(F.broadcast(base)).select("component", "n", "recall_5", "mrr", F.round(F.col("recall_5") - F.col("r0"), 6).alias("recall_lift"), F.round(F.col("mrr") - F.col("m0"), 6).alias("mrr_lift"))


def classification_metrics(pairs: DataFrame, per: list[str] = []) -> DataFrame:
    """Precision, recall and F1 of expected (boolean) against found (boolean)."""
    tp, fp, fn = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("expected") & F.col("found"), ~F.col("expected") & F.col("found"), F.col("expected") & ~F.col("found")))
    g = pairs.groupBy(*per).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return g.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})


def baseline_compare(current: DataFrame, baseline: DataFrame, lower_is_better: list[str] = ["ms", "latency", "seconds"], tolerance: float = 0.1) -> DataFrame:
    """Metrics of two runs (benchmark, metric, value) side by side: change and verdict (same, better, worse beyond the tolerance)."""
    j = current.join(baseline.withColumnRenamed("value", "before"), ["benchmark", "metric"])
    change = F.try_divide(F.col("value") - F.col("before"), F.abs("before"))
    low = F.lit(False)
    for w in lower_is_better:
        low = low | F.contains(F.col("metric"), F.lit(w))
    good = F.when(low, -change).otherwise(change)
    return j.select("benchmark", "metric", "before", "value", F.round(change, 6).alias("change"), F.when(good.isNull() | (F.abs(good) <= tolerance), "same").when(good > 0, "better").otherwise("worse").alias("verdict"))


def tag_coverage(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """Share of tagged documents, tags per document and distinct tags of a comma list column."""
    t = docs.select(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("t"))
    n = F.size("t")
    every = t.select(F.explode("t").alias("x")).agg(F.countDistinct("x").alias("distinct_tags"))
    return t.agg(F.count("*").alias("documents"), F.round(F.avg((n > 0).cast("double")), 6).alias("tagged"), F.round(F.avg(F.when(n > 0, n)), 6).alias("mean_tags"), F.min(F.when(n > 0, n)).alias("least_tags"), F.max(F.when(n > 0, n)).alias("most_tags")).crossJoin(every)


def latency_summary(times: DataFrame, per: list[str], ms: str = "ms") -> DataFrame:
    """Median, nearest-rank 90th percentile and mean; exact, by rank in sorted order and not in one list."""
    w = Window.partitionBy(*per)
    r = times.withColumn("_r", F.row_number().over(w.orderBy(ms))).withColumn("_n", F.count("*").over(w))
    return r.groupBy(*per).agg(F.count("*").alias("n"), F.round(F.median(ms), 6).alias("median"), F.min(F.when(F.col("_r") >= F.ceil(F.lit(0.9) * F.col("_n")), F.col(ms))).alias("p90"), F.round(F.avg(ms), 6).alias("mean"))


def rubric_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of rubric scores (item, dimension, score), a missing dimension counting 3. weights: dimension, weight."""
    items = scores.select("item").distinct().crossJoin(F.broadcast(weights))  # a handful of dimensions
    j = items.join(scores, ["item", "dimension"], "left")
    return j.groupBy("item").agg(F.round(F.sum(F.coalesce("score", F.lit(3.0)) * F.col("weight")) / F.sum("weight"), 6).alias("weighted"))


def config_averages(results: DataFrame) -> DataFrame:
    """Average score per config (config_no, config, score) and its difference to the first config."""
    a = results.groupBy("config_no", "config").agg(F.round(F.avg("score"), 6).alias("average"), F.count("*").alias("n"))
    return a.withColumn("delta", F.round(F.col("average") - F.first("average").over(Window.orderBy("config_no")), 6))  # one row a config


def shared_top(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """How many of the first k results of a query stay: query_id, shared."""
    top = lambda d: d.filter(F.col("rank") < k).select("query_id", "doc_id").distinct()
    return top(before).join(top(after), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("shared"))


def reranker_lift(ranks: DataFrame, top: int = 5) -> DataFrame:
    """What reranking brings to known queries, one row: hit rates within `top` and mean reciprocal ranks with and without it, and
    their differences. ranks: query_id, with_rank, without_rank (from 0, null if not found)."""
    hit = lambda c: F.avg(F.coalesce((F.col(c) < top).cast("double"), F.lit(0.0)))
    mrr = lambda c: F.avg(F.coalesce(1 / (F.col(c) + 1), F.lit(0.0)))
    out = ranks.agg(F.count("*").alias("queries"), hit("with_rank").alias("with_hit_rate"), mrr("with_rank").alias("with_mrr"), hit("without_rank").alias("without_hit_rate"), mrr("without_rank").alias("without_mrr"))
    out = out.withColumns({"hit_rate_lift": F.col("with_hit_rate") - F.col("without_hit_rate"), "mrr_lift": F.col("with_mrr") - F.col("without_mrr")})
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


def answer_metrics(cases: DataFrame) -> DataFrame:
    """How well questions are answered, one row. cases: answerable (boolean), answer (null: none), expected (array of texts that an
    answer must hold). Accuracy over all, the share of answerable ones answered and of the others left alone, the share of
    expected texts found in answers."""
    yes, has = F.col("answerable"), F.col("answer").isNotNull()
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(F.sum(part.cast("int")), F.sum(whole.cast("int"))), F.lit(0.0)), 6)
    checked = F.when(yes & has, F.size(F.coalesce("expected", F.array().cast("array<string>")))).otherwise(0)
    found = F.when(yes & has, F.size(F.filter(F.coalesce("expected", F.array().cast("array<string>")), lambda e: F.contains(F.col("answer"), e)))).otherwise(0)
    content = F.round(F.coalesce(F.try_divide(F.sum(found), F.sum(checked)), F.lit(1.0)), 6)
    return cases.agg(F.count("*").alias("cases"), share(yes == has, F.lit(True)).alias("accuracy"), share(yes & has, yes).alias("answer_rate"), share(~yes & ~has, ~yes).alias("non_answer_rate"), content.alias("content_accuracy"))


def response_flags(parts: DataFrame) -> DataFrame:
    """What holds of a whole response: reranked only if every collection's part was, low_confidence if any part's was.
    parts: query_id, collection, reranked, low_confidence; a missing flag counts as reranked, and as not low."""
    return parts.groupBy("query_id").agg(F.bool_and(F.coalesce("reranked", F.lit(True))).alias("reranked"), F.bool_or(F.coalesce("low_confidence", F.lit(False))).alias("low_confidence"))


def folder_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files by folder: category (the folders of the path, "" at the top), n."""
    return paths.groupBy(F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"^/+|/+$", "").alias("category")).agg(F.count("*").alias("n"))

"""Mixing of sources to target shares of all tokens, with capped repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.plans import cut, join_small, spread, staged


def source_key(c: Column) -> Column:
    """A source's name without the case and blanks it is spelled with; empty ones are null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def rates(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Repetition rates (source, tokens, target_share, max_repeats, reachable_share, rate).

    sizes: source, tokens; targets: source, target_share, max_repeats. The mix has `total` tokens (default: as many as its
    sources have). A source that would need more than max_repeats copies is held there, and what it lacks goes to the
    others by their shares, until each has what it can give: reachable_share. That is the level L at which the sum of
    least(max_repeats * tokens, L * target_share) is the total; as the sum is concave, L is the greatest of the levels found
    by holding the first k sources in the order of max_repeats * tokens / target_share. A target without tokens can't be
    reached, its share goes to the others too. If all caps together give less than the total, all are held. A source without
    a target has rate 0.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = sizes.withColumn("_k", F.coalesce("source", F.lit("\0"))).join(t.withColumn("_k", F.coalesce("source", F.lit("\0"))).drop("source").withColumn("_t", F.lit(1)), "_k", "full")
    both = both.select(F.nullif(F.col("_k"), F.lit("\0")).alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0.0)).alias("max_repeats"))
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()
    both = cut(both)
    caps = both.filter(live).select(F.col("max_repeats") * F.col("tokens"), "target_share", "tokens", "source").toDF("cap", "share", "tokens", "source")
    one = lambda df, *c: F.broadcast(df.agg(*c))  # noqa: E731  (a single row)
    caps = caps.crossJoin(one(caps, F.coalesce(F.lit(total), F.sum("tokens")).cast("double").alias("_total")))
    w = Window.orderBy(F.col("cap") / F.col("share"), "source")  # at most as many rows as targets
    caps = caps.withColumns({"held": F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("share").over(w.rowsBetween(0, Window.unboundedFollowing))})
    level = one(caps, F.max((F.col("_total") - F.col("held")) / F.col("left")).alias("_level"), (F.max("_total") >= F.sum("cap")).alias("_all"))
    given = F.when(live, F.when(F.col("_all"), F.col("max_repeats") * F.col("tokens")).otherwise(F.least(F.col("max_repeats") * F.col("tokens"), F.col("_level") * F.col("target_share")))).otherwise(0.0)
    both = both.crossJoin(level).withColumn("_given", given).drop("_level", "_all")
    both = both.crossJoin(one(both, F.sum("_given").alias("_sum")))
    return both.withColumns({"reachable_share": F.coalesce(F.try_divide("_given", "_sum"), F.lit(0.0)), "rate": F.when(live, F.col("_given") / F.col("tokens")).otherwise(0.0)}).drop("_given", "_sum")


def mix(df: DataFrame, id: str, source: str, text: str, targets: DataFrame, seed: int = 0, total: int | None = None, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and the shares it reaches.

    Each document is emitted floor(rate) times, and once more with the probability of the rate's fraction, drawn from a hash
    of its id and the seed. Result: mix (id, source, copy from 1, n_tokens), shares (source, documents, tokens, target_share,
    max_repeats, reachable_share, rate, mixed_tokens, actual_share). Null and empty texts count 0 tokens; a null source has no
    target; rows of one id are drawn alike. total: as for `rates`. An empty input gives an empty mix and the targets with zero shares.
    """
    rows = spread(df.select(F.col(id).alias("_id"), source_key(F.col(source)).alias("_source"), F.col(text).alias("_text")))
    sized = staged(rows.select("_id", "_source", tokens.count_tokens(F.col("_text"), folder, vocabulary).alias("_n")))
    sizes = sized.groupBy("_source").agg(F.sum("_n").alias("tokens"), F.count("*").alias("documents")).withColumnRenamed("_source", "source")
    rate = cut(rates(sizes.select("source", "tokens"), targets, total))
    chosen = join_small(sized.filter("_source is not null"), rate.select(F.col("source").alias("_source"), "rate").filter("rate > 0"), ["_source"], "inner")
    coin = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    mixed = chosen.withColumn("_copies", copies).filter("_copies > 0")
    got = mixed.groupBy("_source").agg(F.sum(F.col("_n") * F.col("_copies")).alias("mixed_tokens")).withColumnRenamed("_source", "source")
    shares = rate.join(sizes.select("source", "documents"), rate["source"].eqNullSafe(sizes["source"]), "left").drop(sizes["source"]).join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    shares = shares.withColumn("documents", F.coalesce("documents", F.lit(0)))
    whole = F.broadcast(got.agg(F.sum("mixed_tokens").alias("_whole")))  # a single row
    shares = shares.crossJoin(whole).withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", "_whole"), F.lit(0.0))).drop("_whole")
    out = mixed.select(F.col("_id").alias(id), F.col("_source").alias("source"), F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"), F.col("_n").alias("n_tokens"))
    return out, shares.select("source", "documents", "tokens", "target_share", "max_repeats", "reachable_share", "rate", "mixed_tokens", "actual_share")

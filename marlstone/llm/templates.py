"""Templates of pages of one host, by equivalence classes of tokens.

Tokens that occur equally often on each of the host's pages belong together: their occurrence vectors are the same. A class is
valid if its tokens stand in one order wherever they occur, and if it doesn't interleave with a better one; valid classes are
nested in each other. What stands between a page's template tokens are its slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans import spread, staged, with_fields

#: Pages that a class must occur on, and tokens it must have.
LEAST_PAGES, LEAST_TOKENS = 3, 3
#: Words, runs of signs, line ends.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\n"
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def _nest(intervals: list[tuple[int, int, int]]) -> list[tuple[int, int | None, int | None]]:
    """(class, class around it, class it crosses) of each occurrence (start, end, class) on a page."""
    out, open_ = [], []
    for a, z, k in sorted(intervals, key=lambda x: (x[0], -x[1])):
        while open_ and open_[-1][1] < a:
            open_.pop()
        crossed = next((o[2] for o in reversed(open_) if o[1] < z), None)
        around = next((o[2] for o in reversed(open_) if o[1] > z and o[2] != k), None)
        out.append((k, around, crossed))
        open_.append((a, z, k))
    return out


def deduce_templates(df: DataFrame, text: str, host: str, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Classes of each host's pages, and where they stand: classes (host, class, tokens in their order, pages, occurrences, valid,
    parent: the class around all of its occurrences), places (host, page, pos, class; of valid classes).

    A page is a different text of a host, named by its MD5: copies count once. Occurrence vectors are compared by two hashes of
    their entries, so they are never collected; a class's tokens and a page's places are bounded by a page's length. Null and
    empty texts are no pages, a null host is a host. Other columns don't matter.
    """
    base = spread(df.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("_t")).filter("_t <> ''"))
    pages = base.groupBy("host", F.md5("_t").alias("page")).agg(F.first("_t").alias("_t"))
    at = staged(pages.select("host", "page", F.posexplode(tokens(F.col("_t"))).alias("pos", "token")))
    key = F.coalesce("host", F.lit("\0"))
    counts = at.groupBy("host", "page", "token").agg(F.count("*").alias("c"))
    vectors = counts.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("c").alias("n"), F.bit_xor(F.xxhash64("page", "c")).alias("v1"), F.bit_xor(F.xxhash64("c", "page", F.lit(1))).alias("v2"))
    classes = vectors.filter(F.col("pages") >= least_pages).groupBy("host", "v1", "v2", "pages", "n").agg(F.collect_set("token").alias("set")).filter(F.size("set") >= least_tokens)
    classes = staged(classes.select("host", F.xxhash64(key, "v1", "v2").alias("class"), "set", "pages", F.col("n").alias("occurrences")))
    member = classes.select(F.col("host").alias("_h"), "class", F.size("set").alias("size"), F.explode("set").alias("token"))
    found = staged(at.join(member, (F.col("host").eqNullSafe(F.col("_h"))) & (at["token"] == member["token"])).select("host", "page", "pos", "class", "size", at["token"]))
    run = found.groupBy("host", "page", "class", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("seq"))
    first = F.transform(F.slice("seq", F.lit(1), F.col("size")), lambda x: x["token"])
    periodic = F.forall(F.transform("seq", lambda x, i: x["token"] == F.get(F.col("seq"), i % F.col("size"))["token"]), lambda b: b)
    run = run.withColumns({"first": first, "ordered": periodic})
    order = run.groupBy("host", "class").agg(F.bool_and("ordered").alias("ordered"), F.count_distinct(F.md5(F.to_json("first"))).alias("orders"), F.min("first").alias("tokens"))
    good = staged(classes.join(order.withColumnRenamed("host", "_h"), "class").drop("_h").withColumn("one", F.col("ordered") & (F.col("orders") == 1)))
    spans = run.join(good.filter("one").select("class"), "class", "left_semi").select("host", "page", "class", "size", F.transform(F.sequence(F.lit(0), (F.size("seq") / F.col("size")).cast("int") - 1), lambda i: F.struct(F.get("seq", i * F.col("size"))["pos"].alias("a"), F.get("seq", i * F.col("size") + F.col("size") - 1)["pos"].alias("z"))).alias("spans"))
    per_page = spans.groupBy("host", "page").agg(F.collect_list(F.struct("class", "spans")).alias("all"))

    def nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for every in b["all"] for r in set(_nest([(s["a"], s["z"], c["class"]) for c in every for s in c["spans"]]))]
            yield pd.DataFrame(rows, columns=["class", "parent", "crossed"]).astype({"class": "Int64", "parent": "Int64", "crossed": "Int64"})

    nested = staged(per_page.select("all").mapInPandas(nest, "class long, parent long, crossed long").distinct())
    weight = good.select("class", (F.size("set") * F.col("pages")).alias("w"))
    crossing = nested.filter("crossed is not null").select("class", "crossed").distinct()
    both = crossing.unionByName(crossing.select(F.col("crossed").alias("class"), F.col("class").alias("crossed"))).distinct()
    both = both.join(weight, "class").join(weight.select(F.col("class").alias("crossed"), F.col("w").alias("w2")), "crossed")
    lost = both.filter("w < w2 or (w = w2 and class > crossed)").select("class").distinct()
    parents = nested.groupBy("class").agg(F.count_distinct(F.coalesce("parent", F.lit(0))).alias("_n"), F.max("parent").alias("parent"))
    out = good.join(lost.withColumn("_lost", F.lit(True)), "class", "left").join(parents, "class", "left")
    valid = F.col("one") & F.col("_lost").isNull()
    out = staged(out.select("host", "class", "tokens", "pages", "occurrences", valid.alias("valid"), F.when(valid & (F.col("_n") == 1), F.col("parent")).alias("parent")))
    return out, found.join(out.filter("valid").select("class"), "class", "left_semi").select("host", "page", "pos", "class")


def extract_slots(df: DataFrame, text: str, host: str, keep: list[str], places: DataFrame) -> DataFrame:
    """The slots of each text: `keep`, slots (the stretches between its page's template tokens), template_tokens. A text without
    any is one slot; null and empty texts have none."""
    base = df.select(F.struct(*keep).alias("_keep"), F.col(host).cast("string").alias("_h"), F.col(text).cast("string").alias("_t")).withColumn("_p", F.md5("_t"))
    of = places.groupBy(F.coalesce("host", F.lit("\0")).alias("_hk"), F.col("page").alias("_p")).agg(F.sort_array(F.collect_set("pos")).alias("_at"))
    j = base.withColumn("_hk", F.coalesce("_h", F.lit("\0"))).join(of, ["_hk", "_p"], "left").select("_keep", "_t", "_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots, counts = [], []
            for t, at in zip(b["_t"], b["_at"]):
                marked, own, end = set() if at is None else set(at), [], 0
                for i, m in enumerate(_TOKEN.finditer(t or "")):
                    if i in marked:
                        own.append(t[end : m.start()])
                        end = m.end()
                own.append((t or "")[end:])
                slots.append([s for s in own if s.strip()])
                counts.append(len(marked))
            yield pd.DataFrame({"_keep": b["_keep"], "slots": slots, "template_tokens": counts})

    return j.mapInPandas(run, with_fields(j.select("_keep").schema, "slots array<string>, template_tokens int")).select("_keep.*", "slots", "template_tokens")

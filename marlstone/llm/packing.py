"""Packing of texts into containers of fixed capacity by the sum-of-squares rule.

N(g) counts the open containers with a gap of g. An item goes where the sum of N(g) squared becomes smallest, which keeps
gaps of every size in stock. Items are packed in shards of a fixed amount of tokens, each on its own; only sizes move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.splitting import split_texts
from marlstone.plans import staged, with_fields

#: Tokens packed by one task; a shard of average texts has some tens of thousands of items.
SHARD_TOKENS = 8_000_000
#: The most tokens of one character: one a byte.
MOST_TOKENS = 4


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item, in the order given. Sizes are from 0 to `capacity`; items of size 0 go to container 0."""
    if len(sizes) and (sizes.min() < 0 or sizes.max() > capacity):
        raise ValueError("an item doesn't fit")
    count = np.zeros(capacity + 1, np.int64)  # N(g); full and unopened containers aren't counted
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            opened = max(opened, 1) if not opened else opened
            if opened == 1 and i == 0:
                count[capacity] += 1
                held[capacity].append(0)
            continue
        # change of the sum for a gap g -> g - s, for g = s .. capacity
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        change[0] = -2 * count[s] + 1
        change[count[s:] == 0] = np.iinfo(np.int64).max
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = s + int(change.argmin())
        if change[g - s] <= new and count[g] > 0:
            b = held[g].pop()
            count[g] -= 1
        else:
            b, g = opened, capacity
            opened += 1
        out[i] = b
        if g > s:
            count[g - s] += 1
            held[g - s].append(b)
    return out


def pack(items: DataFrame, id: list[str], size: str, capacity: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers for items of at most `capacity`.

    Result: container (long), the id columns, size, used and unused of the container. Items come in the order of their hash
    (the rule is made for items in any order; on this corpus it leaves less unused than descending sizes); repeated ids are items of their own; a null size counts as 0. Shards are drawn by hash,
    so no key decides their size; their number follows the total. An empty input gives no container.
    """
    base = items.select(*id, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    total = base.agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    base = base.withColumn("_order", F.xxhash64(*id)).withColumn("_shard", F.pmod(F.col("_order"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", *id], kind="stable")
        own = sum_of_squares(pdf["_size"].to_numpy(), capacity)
        used = np.bincount(own, pdf["_size"], own.max() + 1).astype("int64")[own]
        return pdf[id].assign(container=own + pdf["_shard"].astype("int64") * (1 << 32), n_tokens=pdf["_size"], used=used, unused=capacity - used)

    schema = with_fields(base.select(*id).schema, "container long, n_tokens long, used long, unused long")
    return base.groupBy("_shard").applyInPandas(run, schema).select("container", *id, "n_tokens", "used", "unused")


def pack_texts(df: DataFrame, id: str, text: str, capacity: int, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Texts in containers of `capacity` tokens: whole where they fit, else in pieces cut at natural boundaries.

    Result: container, id, piece, start, end (characters), n_tokens, used, unused. Null and empty texts take no room: they
    are listed with piece 0 and 0 tokens. One character has up to MOST_TOKENS tokens, so no capacity may be smaller.
    """
    if capacity < MOST_TOKENS:
        raise ValueError(f"a character may have {MOST_TOKENS} tokens")
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.lit(capacity).alias("_limit"), F.lit(0).alias("_overlap"))
    pieces = split_texts(rows, "_text", ["_id"], "_limit", "_overlap", "token", folder, vocabulary).select("_id", "piece", "start", "end", F.col("units").alias("_n"))
    none = rows.filter("_text is null or _text = ''").select("_id", *[F.lit(0).alias(c) for c in ("piece", "start", "end", "_n")])
    items = staged(pieces.unionByName(none))
    return pack(items, ["_id", "piece", "start", "end"], "_n", capacity).withColumnRenamed("_id", id)

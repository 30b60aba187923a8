"""Splitting of oversized texts at natural boundaries, with a fixed overlap.

Sizes are prefix sums: where each unit (character or token) starts. From a piece's start, binary search in the sorted
boundaries finds the last one within the limit; the next piece starts the overlap before that cut. Where no boundary
lies in reach, the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.plans import spread, with_fields

#: Kinds of boundary, the strongest first, and how full a piece must be for a cut there (share of the limit).
KINDS = [
    ("paragraph", re.compile(r"\n[ \t]*(?:\n\s*)+|\n(?=#{1,6} |h[1-6]\. )"), 0.5),
    ("sentence", re.compile(r"[.!?…](?:[\"'”’)\]]*)\s+|\n+|\s+(?=\[?\(?\d{1,2}:\d{2}(?::\d{2})?\)?\]?\s)"), 0.3),
    ("clause", re.compile(r"[,;:–—]\s+"), 0.5),
    ("word", re.compile(r"\s+"), 0.0),
]


def split(text: str, limit: int, overlap: int, starts: np.ndarray | None = None, count: Callable[[str], int] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, units, kind of the cut) of each piece, in characters.

    starts: where each unit starts, and the end (default: units are characters). count: the units of a piece by itself, where
    a cut may change them; a piece over the limit is then cut again with that much less room. Pieces hold at most `limit`
    units, but for a single character that has more. The next piece starts `overlap` units before the cut (where a unit
    starts there), and always after the start and far enough to reach beyond the end of the one before.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    end = len(text)
    if not text:
        return []
    n = end if starts is None else len(starts) - 1
    if n <= limit:
        return [(0, end, n, "end")]
    before = np.arange(end + 1) if starts is None else np.searchsorted(starts[:-1], np.arange(end + 1), "left")  # units begun before each character
    at = [np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for _, pattern, _ in KINDS]

    def last(units: int) -> int:
        """The last character with at most so many units before it."""
        return int(np.searchsorted(before, units, "right")) - 1

    def boundary(a: int, room: int) -> tuple[int, str]:
        top = max(a + 1, last(before[a] + room))
        if top >= end:
            return end, "end"
        for (name, _, fill), ends in zip(KINDS, at):
            i = int(np.searchsorted(ends, top, "right")) - 1
            if i >= 0 and ends[i] > a and before[ends[i]] > before[a] + max(overlap, int(fill * limit)):
                return int(ends[i]), name
        return top, "hard"

    out, a = [], 0
    while True:
        room = limit
        while True:
            z, kind = boundary(a, room)
            held = int(before[z] - before[a])
            units = held if count is None else count(text[a:z])
            if units <= limit or z == a + 1:
                break
            room = max(0, min(room, held) - (units - limit))
        out.append((a, z, units, kind))
        if z == end:
            return out
        need = int(before[z + 1] - limit)  # the next character must find room
        fit = last(need) if need > 0 else 0
        fit += bool(before[fit] < need)
        a = min(z, max(last(before[z] - overlap), fit, a + 1))


def split_by_tokens(text: str, limit: int, overlap: int, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> list[tuple[int, int, int, str]]:
    """As `split`, in tokens; units are the tokens of the piece by itself."""
    e, starts = tokens.encoding(folder, vocabulary), tokens.token_starts(text, folder, vocabulary)
    return split(text, limit, overlap, starts, lambda t: len(e.encode_ordinary(t)))


def split_texts(df: DataFrame, text: str, keep: list[str], limit: str, overlap: str, unit: str = "char", folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The pieces of each text.

    limit, overlap: integer columns (a null limit: never split; a null overlap: 0); unit: "char" (code points) or "token".
    Result: `keep`, n_pieces, piece (from 0), start, end (characters from 0), units, cut (the kind of boundary at its end:
    paragraph, sentence, clause, word, hard, or end), piece_text. Null and empty texts have no pieces; a text within the
    limit is one piece. Repeated rows are split each; other columns don't matter.
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.col(text).cast("string").alias("_text"), F.col(limit).cast("long").alias("_limit"), F.coalesce(F.col(overlap).cast("long"), F.lit(0)).alias("_overlap")))
    # a text can't have more tokens than bytes: shorter ones stay in the JVM, unless their tokens must be counted
    long = F.col("_text").isNotNull() & ((F.length("_text") > F.col("_limit")) if unit == "char" else (F.length("_text") > 0))
    base = base.withColumn("_long", F.when(long, F.col("_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = []
            for t, most, over in zip(b["_long"], b["_limit"], b["_overlap"]):
                if t is None:
                    every.append(None)
                    continue
                cap = int(most) if most == most and most is not None else max(len(t), 1) * 4
                pieces = split_by_tokens(t, cap, int(over), folder, vocabulary) if unit == "token" else split(t, cap, int(over))
                every.append([{"start": a, "end": z, "units": u, "cut": k} for a, z, u, k in pieces])
            yield pd.DataFrame({"_keep": b["_keep"], "_text": b["_text"], "_pieces": every})

    schema = with_fields(base.select("_keep", "_text").schema, "_pieces array<struct<start:int,end:int,units:int,cut:string>>")
    cut = base.mapInPandas(run, schema)
    whole = F.when(F.length("_text") > 0, F.array(F.struct(F.lit(0).alias("start"), F.length("_text").alias("end"), F.length("_text").alias("units"), F.lit("end").alias("cut"))))
    cut = cut.withColumn("_pieces", F.coalesce("_pieces", whole)).select("_keep", "_text", F.size("_pieces").alias("n_pieces"), F.posexplode("_pieces").alias("piece", "p"))
    return cut.select("_keep.*", "n_pieces", "piece", "p.*", F.substring(F.col("_text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece_text"))

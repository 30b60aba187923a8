"""Near duplicates: Golay-code fuzzy hashing finds candidates, exact shingle sets verify them.

A document's fingerprint is a sum of random signs over its word pairs, cut into segments of 24 numbers. Each segment is
decoded to its nearest Golay codewords, which tolerates the bits that a few edits flip; a key joins the codewords of some
segments. By the pigeonhole principle, edits that spoil some segments leave others whole, so similar documents share a key
of some group of segments. How many segments make a key, and how many groups there are, follows from the documents' number
and the threshold. Candidates are verified on the exact sets of shingles.

What is on disk at a time is in proportion to the documents: texts and codewords are staged, keys are not. Groups of segments
take their turn in passes; in each the documents are dealt by the first codeword of a key, with their sketch, so that pairs
which meet by chance (their number grows with the square of the documents) are dropped where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import golay
from marlstone.plans import spread, staged, unstage

#: The chance with which a pair right at the threshold is found, and the most segments of a fingerprint.
RECALL, MOST_SEGMENTS = 0.95, 128
#: Bits of the sketch of a document's shingles, by which candidates are dropped that can't reach the threshold.
SKETCH_BITS = 256
#: Documents fingerprinted at once, and shingles of them.
BATCH, CHUNK = 64, 1 << 13
#: Bytes a document that a pass may shuffle, those that any pass may, and those that a task of it reads.
PASS_BYTES, LEAST_PASS, DEALT_BYTES = 512, 1 << 27, 1 << 24
#: Pairs compared at once, and pairs held before they are handed on.
COMPARED, HELD = 1 << 16, 1 << 20
#: Stands for a null group inside the operator.
NULL_GROUP = "\0null"


def words(text: Column) -> Column:
    """The longest runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(h: Column, n: int) -> Column:
    """The distinct hashes of n consecutive words, of the words' hashes; none for fewer words."""
    at = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))).otherwise(F.array().cast("array<bigint>"))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(hashes: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Per document (its hashes end at ends[i]) the sums of random signs, documents x bits. Long documents are summed in parts."""
    sums = np.zeros((len(ends), bits), np.float32)
    seeds = range(-(-bits // 64))
    start = np.concatenate([[0], ends[:-1]])
    for at in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        to = min(at + CHUNK, int(ends[-1]))
        own = hashes[at:to]
        signs = np.unpackbits(np.stack([_mix(own, s) for s in seeds], 1).view(np.uint8), axis=1)[:, :bits]
        first = int(np.searchsorted(ends, at, "right"))
        for i in range(first, len(ends)):
            a, b = max(int(start[i]), at), min(int(ends[i]), to)
            if a >= to:
                break
            if b > a:
                sums[i] += signs[a - at : b - at].sum(0, dtype=np.int32) * 2.0 - (b - a)
    return sums


@cache
def shared_codeword(cosine: float, codewords: int) -> float:
    """The chance that two segments of documents of this cosine have a codeword in common, by simulation."""
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 24)).astype(np.float32)
    b = cosine * a + (1 - cosine**2) ** 0.5 * rng.standard_normal(a.shape).astype(np.float32)
    x, y = golay.nearest(a, codewords), golay.nearest(b, codewords)
    return float(((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2)).mean())


def plan_keys(documents: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(segments a key, keys' segment groups, codewords a segment) that find a pair at the threshold with at least this chance
    at the least cost: the keys' rows, and the pairs that meet by chance, which grow with the square of the documents (counted
    twice, as the texts of one collection share some words)."""
    c = cosine_of(threshold)
    best = None
    for codewords in (2, 3):
        p, q = shared_codeword(round(c, 3), codewords), codewords**2 / 4096
        for width in (1, 2, 3, 4):
            groups = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p**width))))
            if groups * width > MOST_SEGMENTS:
                continue
            cost = documents * groups * (codewords**width + width) + documents**2 * groups * q**width
            if best is None or cost < best[0]:
                best = (cost, width, groups, codewords)
    if best is None:
        raise ValueError("no plan finds pairs of so low a threshold; lower the recall")
    return best[1:]


def cosine_of(threshold: float) -> float:
    """The least cosine of two sets whose intersection is this share of their union."""
    return 2 * threshold / (1 + threshold)


def sketch_limit(threshold: float, bits: int = SKETCH_BITS) -> int:
    """Differing bits of two sketches of sets at the threshold, and six standard deviations more: of a billion pairs one is
    over it by chance. The sketch is made of the very sets that are verified, so the bound holds for any texts."""
    p = float(np.arccos(cosine_of(threshold)) / np.pi)
    return int(np.ceil(bits * p + 6 * (bits * p * (1 - p)) ** 0.5))


def _codes(width: int, groups: int, codewords: int):
    """Per document a sketch (SKETCH_BITS) and two bytes for each nearest codeword of each segment; a segment's missing codeword
    is given as its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                flat = {}
                for c in ("_pairs", "_set"):
                    offsets = np.asarray(b.column(c).offsets)
                    flat[c] = np.asarray(b.column(c).values)[offsets[0] : offsets[-1]].view(np.uint64), offsets[1:] - offsets[0]
                n = b.num_rows
                near = golay.nearest(fingerprints(*flat["_pairs"], groups * width * 24).reshape(-1, 24) + 1e-3, codewords)
                near = np.where(near < 0, near[:, :1], near).astype("<u2").reshape(n, -1)
                sketch = np.packbits(fingerprints(*flat["_set"], SKETCH_BITS) > 0, axis=1)
                own = np.concatenate([sketch, near.view(np.uint8).reshape(n, -1)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("_n"), b.column("_x"), _blobs(own.ravel(), np.arange(n + 1) * own.shape[1])], names=["_n", "_x", "_code"])

    return run


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


#: A record of a document and a first codeword, in words of 8 bytes: number, sketch, then the text's group (9 bits), the segments'
#: group (7), the first codeword (12) and up to three of the others; further ones, five a word.
_HEAD = 1 + SKETCH_BITS // 64


def record_words(width: int, codewords: int) -> int:
    return _HEAD + 1 + -(-max(0, (width - 1) * codewords - 3) // 5)


def _deal(groups: range, width: int, codewords: int, parts: int):
    """Records of the keys of some groups of segments, put together by the part that their group and first codeword belong to."""
    size, others = record_words(width, codewords), (width - 1) * codewords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            offsets = np.frombuffer(b.column("_code").buffers()[1], np.int32)[b.column("_code").offset :][: n + 1]
            code = np.frombuffer(b.column("_code").buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)
            near = np.ascontiguousarray(code[:, SKETCH_BITS // 8 :]).view("<u2").reshape(n, -1, width, codewords)[:, groups.start : groups.stop].astype(np.uint64)
            r = np.empty((n, len(groups), codewords, size), np.uint64)
            r[..., 0] = np.asarray(b.column("_n")).view(np.uint64)[:, None, None]
            r[..., 1:_HEAD] = np.ascontiguousarray(code[:, : SKETCH_BITS // 8]).view(np.uint64)[:, None, None, :]
            x = np.asarray(b.column("_x")).astype(np.uint64)[:, None, None]
            r[..., _HEAD] = (x << np.uint64(19) | np.array(groups, np.uint64)[None, :, None] << np.uint64(12) | near[:, :, 0, :]) << np.uint64(36)
            r[..., _HEAD + 1 :] = 0
            rest = near[:, :, 1:, :].reshape(n, len(groups), others)
            for k in range(others):
                word, bit = (_HEAD, 12 * k) if k < 3 else (_HEAD + 1 + (k - 3) // 5, 12 * ((k - 3) % 5))
                r[..., word] |= (rest[:, :, k] << np.uint64(bit))[:, :, None]
            r = r.reshape(-1, size)
            # a codeword that stands for a missing one has the records of the first already
            again = np.zeros((n, len(groups), codewords), bool)
            again[:, :, 1:] = near[:, :, 0, 1:] == near[:, :, 0, :1]
            r = r[~again.reshape(-1)]
            part = (_mix(r[:, _HEAD] >> np.uint64(36), 0) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            r, part = r[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.concatenate([first, [len(part)]]) * size * 8
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), _blobs(r.view(np.uint8).ravel(), ends)], names=["_p", "_records"])

    return run


def _meet(width: int, codewords: int, limit: int):
    """The pairs of records of a part that share a key and whose sketches are within the limit, each pair once."""
    size = record_words(width, codewords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, size) for b in batches for x in b.column("_records")]
        if not blobs:
            return
        r = np.concatenate(blobs)
        del blobs
        keys = (r[:, _HEAD] >> np.uint64(36))[:, None]
        for s in range(width - 1):  # every choice of one codeword of each further segment
            own = []
            for k in range(s * codewords, (s + 1) * codewords):
                word, bit = (_HEAD, 12 * k) if k < 3 else (_HEAD + 1 + (k - 3) // 5, 12 * ((k - 3) % 5))
                own.append(r[:, word] >> np.uint64(bit) & np.uint64(0xFFF))
            keys = (keys[:, :, None] << np.uint64(12) | np.stack(own, 1)[:, None, :]).reshape(len(r), -1)
        choices = keys.shape[1]
        keys = keys.ravel()
        order = np.argsort(keys)
        keys = keys[order]
        number, sketch = r[:, 0].copy(), r[:, 1:_HEAD].copy()
        del r
        order //= choices
        found, held, apart = [], 0, 1
        near = np.flatnonzero(keys[1:] == keys[:-1])
        while len(near):  # the rows whose key is also that of the row `apart` rows on
            for at in range(0, len(near), COMPARED):
                i = near[at : at + COMPARED]
                a, b = order[i], order[i + apart]
                ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int32) <= limit
                x, y = number[a[ok]].view(np.int64), number[b[ok]].view(np.int64)
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
                held += len(found[-1])
                if held > HELD:
                    found = [_once(found)]
                    if len(found[0]) > HELD // 2:
                        yield _pairs_of(found.pop())
                    held = sum(map(len, found))
            apart += 1
            near = near[near + apart < len(keys)]
            near = near[keys[near + apart] == keys[near]]
        if held:
            yield _pairs_of(_once(found))

    return run


def _once(pairs: list[np.ndarray]) -> np.ndarray:
    p = np.concatenate(pairs)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])] if len(p) else p


def _pairs_of(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["_a", "_b"])


def candidates(codes: DataFrame, documents: int, width: int, groups: int, codewords: int, limit: int) -> DataFrame:
    """Pairs of documents (_a < _b, each once) that share a key and whose sketches differ in `limit` bits at most. As many groups
    of segments are dealt at once as PASS_BYTES allows."""
    a_group = max(1, documents) * codewords * record_words(width, codewords) * 8
    at_once = max(1, max(documents * PASS_BYTES, LEAST_PASS) // a_group)
    passes = -(-groups // at_once)
    found = []
    for k in range(passes):
        own = range(groups * k // passes, groups * (k + 1) // passes)
        parts = max(codes.sparkSession.sparkContext.defaultParallelism, -(-len(own) * a_group // DEALT_BYTES))
        dealt = codes.mapInArrow(_deal(own, width, codewords, parts), "_p int, _records binary").repartitionById(parts, "_p")
        found.append(staged(dealt.mapInArrow(_meet(width, codewords, limit), "_a long, _b long").distinct(), lean=True))
    if len(found) == 1:
        return found[0]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    out = staged(out.distinct(), lean=True)
    unstage(*found)
    return out


def near_duplicates(df: DataFrame, id: str, text: str, group: str | None = None, threshold: float = 0.8, size: int = 5, least_words: int = 20, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences, and the links between classes.

    df: rows with a unique `id` (long) and a `text`; rows are only compared within one value of `group` (null counts as
    a value). Words are the longest runs of letters and digits, lower-cased; texts under `least_words` words (null and
    empty ones too) are in no class. Two classes are linked if their sets of `size` consecutive words have an intersection
    of at least `threshold` of their union. Candidates come from Golay keys, planned so that a pair right at the threshold is
    found with the chance `recall`, more similar ones nearly always; no cap applies to a key's documents.

    Result: members (group, id, rep: the least id of the class), links (group, rep_a, rep_b, similarity; rep_a < rep_b).
    An empty input gives empty results; other columns don't matter.
    """
    least_words = max(least_words, size)
    named = F.coalesce(F.col(group).cast("string"), F.lit(NULL_GROUP)) if group else F.lit("")
    base = spread(df.select(named.alias("_g"), F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text")).filter("_id is not null"))
    w = base.withColumn("_w", words(F.col("_text"))).filter(F.size("_w") >= least_words).select("_g", "_id", F.concat_ws(" ", "_w").alias("_text"))
    w = staged(w.withColumn("_md5", F.unhex(F.md5("_text"))), lean=True)
    reps = w.groupBy("_g", "_md5").agg(F.min("_id").alias("_rep"))
    members = staged(w.select("_g", "_id", "_md5").join(reps, ["_g", "_md5"]).select("_g", "_id", "_rep"), lean=True)
    # classes get numbers of their own: pairs, of which there are many, are then two longs a row
    own = w.drop("_md5").join(members.filter("_id = _rep").select("_g", "_id"), ["_g", "_id"], "left_semi")
    own = staged(own.withColumn("_n", F.monotonically_increasing_id()), lean=True)
    unstage(w)
    documents = own.count()
    width, groups, codewords = plan_keys(documents, threshold, recall)
    hashes = F.transform(F.split("_text", " "), lambda x: F.xxhash64(x))
    # the group as nine bits of the key: pairs of two groups that share them are dropped below
    hashed = own.select("_n", F.pmod(F.xxhash64("_g"), F.lit(512)).cast("int").alias("_x"), hashes.alias("_h")).select("_n", "_x", shingles(F.col("_h"), 2).alias("_pairs"), shingles(F.col("_h"), size).alias("_set"))
    codes = staged(hashed.mapInArrow(_codes(width, groups, codewords), "_n long, _x int, _code binary"), lean=True)
    pair = candidates(codes, documents, width, groups, codewords, sketch_limit(threshold))
    unstage(codes)
    met = pair
    for x in ("_a", "_b"):
        met = met.join(own.select(F.col("_n").alias(x), F.col("_g").alias(f"{x}_g"), F.col("_id").alias(f"{x}_id"), F.col("_text").alias(f"{x}_text")), x)
    met = met.filter(F.col("_a_g") == F.col("_b_g"))
    for x in ("_a", "_b"):
        met = met.withColumn(f"{x}_h", F.transform(F.split(f"{x}_text", " "), lambda t: F.xxhash64(t))).withColumn(f"{x}_set", shingles(F.col(f"{x}_h"), size))
    met = met.withColumn("_both", F.size(F.array_intersect("_a_set", "_b_set")))
    share = F.col("_both") / (F.size("_a_set") + F.size("_b_set") - F.col("_both"))
    # staged before it is filtered: a filter would be pushed down and compute the sets again, for each word
    met = staged(met.select(F.col("_a_g").alias("_g"), F.least("_a_id", "_b_id").alias("rep_a"), F.greatest("_a_id", "_b_id").alias("rep_b"), share.alias("similarity")), lean=True)
    unstage(own, pair)
    links = met.filter(F.col("similarity") >= threshold)
    name = F.nullif(F.col("_g"), F.lit(NULL_GROUP)).alias(group or "group")
    return members.select(name, F.col("_id").alias("id"), F.col("_rep").alias("rep")), links.select(name, "rep_a", "rep_b", "similarity")

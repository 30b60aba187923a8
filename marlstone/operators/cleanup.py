"""Cleaning of document collections: what a body amounts to, noise by path and title, exclusion cascades, sanitising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# Lines that carry nothing, by source.
LINE_NOISE = {
    "confluence": [r"^#{1,6}\s+(?:Aktivitet|Bidragsytere|Spaceeier)\s*$", r"^https?://\S+$", r"^\[.+\]\(https?://\S+\)$", r"^Sjekk .*:.*https?://", r"^\*\*Spaceeier:\*\*\s*$"],
    "jira": [r"^#\s+\S+-\d+:", r"^\*\*Epic:\*\*", r"^#{1,6}\s+"],
    "notion": [r"^\[Child database:.*\]$", r"^\[Child page:.*\]$", r"^\[Unsupported:.*\]$"],
}
# Lines of personal notes, and marks of work in progress in titles and lines.
PERSONAL_LINES = [r"@@", r"(?iU)^\s*\S+\s+(?:følger opp|tar det videre|sjekker|undersøker)\b"]
PROGRESS_TITLE = r"(?iU)(?:- )?under arbeid|utkast|\bWIP\b"
PROGRESS_LINES = [r"(?iU)^#{1,6}\s+(?:UNDER ARBEID|WIP)\b", r"(?iU)^(?:Under arbeid|WIP)\s*$"]


def meaningful_lines(text: Column, noise: list[str]) -> Column:
    lines = F.filter(F.transform(F.split(F.trim(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    keep = lambda x: ~_any(x, noise)
    return F.filter(lines, keep) if noise else lines


def _any(x: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def classify_body(text: Column, least_length: int, noise: list[str] = [], least_words: int = 0, filtered: str = "reference_only") -> Column:
    """Why a body isn't worth keeping, or null: empty_stub, `filtered` (only noise lines), minimal_content, low_word_count."""
    t = F.coalesce(text, F.lit(""))
    lines = meaningful_lines(t, noise)
    rest = F.array_join(lines, " ")
    reason = F.when(F.regexp_replace(t, r"\s", "") == "", "empty_stub").when(F.size(lines) == 0, filtered).when(F.length(rest) < least_length, "minimal_content")
    return reason.when(F.size(F.split(rest, r"\s+")) < least_words, "low_word_count") if least_words > 0 else reason


#: A hand-written list of patterns is at most this long.
MOST_PATTERNS = 2_000


def match_noise(docs: DataFrame, patterns: DataFrame, on: str = "path") -> DataFrame:
    """The first noise pattern of each document: doc_id, reason. patterns: a hand-written list of pattern_no, kind (glob on the
    path, text in the title), pattern, reason; a longer one than MOST_PATTERNS is an error. Globs and texts match whatever the
    case. The list becomes one expression, so documents are read once and not joined."""
    rows = patterns.select("pattern_no", "kind", "pattern", "reason").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} noise patterns")
    path, title = F.col(on), F.lower("title")

    def hit(r) -> Column:
        if r["kind"] != "glob":
            return F.contains(title, F.lit(r["pattern"].lower()))
        return path.rlike("(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in r["pattern"]) + "$")

    tests = [(r["reason"], hit(r)) for r in sorted((r for r in rows if r["pattern"] is not None), key=lambda r: r["pattern_no"])]
    return docs.select("doc_id", first_reason(*tests).alias("reason")).filter("reason is not null").groupBy("doc_id").agg(F.min("reason").alias("reason"))


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds, or null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def keep_parents(excluded: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Excluded items that kept items name as their parent are kept after all. excluded, kept: key, parent and the same other
    columns. Result: still excluded, rescued."""
    named = kept.select(F.col("parent").alias("key")).filter("key is not null").distinct()
    return excluded.join(named, "key", "left_anti"), excluded.join(named, "key", "left_semi")


def excluded_stubs(excluded: DataFrame, active: DataFrame) -> DataFrame:
    """Excluded items that still belong in the graph: those whose parent is active, and that aren't active themselves, once a key.
    excluded: key, parent and more; active: key."""
    keys = active.select("key").filter("coalesce(key, '') <> ''").distinct()
    stubs = excluded.filter("coalesce(key, '') <> ''").join(keys.withColumnRenamed("key", "parent"), "parent", "left_semi").join(keys, "key", "left_anti")
    return stubs.select(*excluded.columns).dropDuplicates(["key"]).withColumn("from_excluded", F.lit(True))


def recovered_report(was_excluded: DataFrame, active: DataFrame) -> DataFrame:
    """Earlier exclusions by bucket of their reason, and how many are active again: bucket, excluded, recovered."""
    bucket = F.when(F.col("reason").startswith("noise_"), "noise").when(F.col("reason").isin("empty_stub", "minimal_content", "low_word_count", "reference_only"), "content").when(F.col("reason").rlike("age|old"), "age").otherwise("other")
    j = was_excluded.withColumn("bucket", bucket).join(active.select("id", F.lit(1).alias("_a")).distinct(), "id", "left")
    return j.groupBy("bucket").agg(F.count("*").alias("excluded"), F.count("_a").alias("recovered"))


def sanitize_lines(text: Column) -> Column:
    """Text without personal action items and lines of `@@`."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~_any(x, PERSONAL_LINES)), "\n")


def is_work_in_progress(title: Column, text: Column) -> Column:
    """The title says so, or a heading or a line of its own anywhere in the text."""
    return F.coalesce(title, F.lit("")).rlike(PROGRESS_TITLE) | F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: _any(x, PROGRESS_LINES))


def pii_findings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """E-mail addresses and national ids of texts, the values masked: id, category, redacted, line, n-th of its category."""
    d = docs.select(F.col(id), F.col(text).alias("_t"))
    kinds = F.concat(F.transform(tx.national_ids(F.col("_t")), lambda x: F.struct(F.lit("national_id").alias("category"), x.alias("v"))), F.transform(tx.email_addresses(F.col("_t")), lambda x: F.struct(F.lit("email").alias("category"), x.alias("v"))))
    f = d.select(id, "_t", F.posexplode(kinds).alias("pos", "x"))
    masked = F.when(F.col("x.category") == "national_id", F.concat(F.substring("x.v", 1, 6), F.lit("*****"))).otherwise("<redacted-email>")
    return f.select(id, F.col("x.category").alias("category"), masked.alias("redacted"), tx.line_of(F.col("_t"), F.instr("_t", F.col("x.v"))).alias("line"), "pos")


def redact(text: Column) -> Column:
    """Text without the values of `pii_findings` and passwords: passwords first, then ids, then addresses."""
    t = tx.redact_unconditional(text)
    t = F.aggregate(tx.national_ids(t), t, lambda a, v: F.replace(a, v, F.concat(F.substring(v, 1, 6), F.lit("*****"))))
    return F.aggregate(tx.email_addresses(t), t, lambda a, v: F.replace(a, v, F.lit("<redacted-email>")))


def pii_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents and findings by category."""
    return pii_findings(docs, id, text).groupBy("category").agg(F.countDistinct(id).alias("documents"), F.count("*").alias("findings"))


def valid_tags(tagged: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tags (doc_id, tag) that the taxonomy (tag) knows, at their first place only."""
    return tagged.dropDuplicates(["doc_id", "tag"]).join(taxonomy.select("tag").distinct(), "tag", "left_semi")


def tag_histogram(tagged: DataFrame, per: str = "collection") -> DataFrame:
    return tagged.groupBy(per, "tag").agg(F.count("*").alias("n"))


def collection_overview(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per collection."""
    c = chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
    return documents.groupBy("collection").agg(F.count("*").alias("documents")).join(c, "collection", "left").select("collection", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def excluded_manifest(docs: DataFrame, reason: Column, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents to keep, and a manifest of the others: id, reason, path, title."""
    d = docs.withColumn("_reason", reason)
    return d.filter("_reason is null").drop("_reason"), d.filter("_reason is not null").select(F.col(id).alias("id"), F.col("_reason").alias("reason"), F.col("path"), F.col("title"))


def exclusion_moves(files: DataFrame, excluded: DataFrame, folder: str = ".excluded") -> DataFrame:
    """Where files (path) move: those of excluded documents (path, reason) into a folder of the same shape, those there that
    aren't excluded any more back, excluded ones whose file is gone nowhere: path, target, action (exclude, restore, prune)."""
    inside = F.startswith("path", F.lit(f"{folder}/"))
    plain = F.when(inside, F.substring("path", len(folder) + 2, 10_000)).otherwise(F.col("path"))
    f = files.select("path", plain.alias("_plain"), inside.alias("_inside"))
    j = f.join(excluded.select(F.col("path").alias("_plain"), F.lit(True).alias("_out")).distinct(), "_plain", "full_outer")
    action = F.when(F.col("path").isNull(), "prune").when(F.col("_out") & ~F.col("_inside"), "exclude").when(F.col("_out").isNull() & F.col("_inside"), "restore")
    target = F.when(action == "exclude", F.concat(F.lit(f"{folder}/"), "_plain")).when(action == "restore", F.col("_plain"))
    return j.select(F.coalesce("path", "_plain").alias("path"), target.alias("target"), action.alias("action")).filter("action is not null")


def latest_deliveries(df: DataFrame, key: str, at: str = "received_at", tie: str = "ingest_id") -> DataFrame:
    """One row a key, as delivered last; rows without a key stay each. An aggregate: a key of many rows is combined before the
    shuffle."""
    last = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(at, tie)).alias("_r")).select("_r.*")
    return last.unionByName(df.filter(F.col(key).isNull()))

"""Scalar functions on text columns: tokens, titles, tags, snippets, hashes, scores and bands."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds and curve of relevance.
NOISE_SCORE, LOW_SCORE = -0.10, -0.10
SIGMOID_SLOPE, SIGMOID_SHIFT = 8.0, 0.15
HIGH_RELEVANCE, MEDIUM_RELEVANCE, MEDIUM_UNRANKED = 0.65, 0.40, 0.5
# Filler words of Norwegian and English, and the signs stripped from words.
STOPWORDS = set(
    "og men på til for i av en et er var ikke som det den de vi du jeg han hun om med fra ved kan skal vil har hadde være blir hva hvor hvilke hvilken hvordan hvorfor "
    "the a an and or of in on at to for with by is was are were be been being has have had what which where how why who this that these those from into".split()
)
WORD_SIGNS = ".,!?;:\"'()"
# Words between the parts of a query, the first that occurs cuts.
CONJUNCTIONS = [" versus ", " vs. ", " vs ", " and ", " og ", " & "]


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, hyphenated ones whole; underscores part words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"), 1)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def title_from_path(path: Column) -> Column:
    """The last segment of a path, without `.json` at its end."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", "")


def safe_filename(name: Column, limit: int = 200) -> Column:
    """Characters that file systems refuse become underscores; cut to a length."""
    return F.substring(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")), 1, limit)


@F.pandas_udf(T.StringType())
def ascii_slug(s: pd.Series) -> pd.Series:
    """Title as an ASCII slug: decomposed, lower-case, underscores between words, at most 100 characters, else `untitled`."""
    def one(t: str | None) -> str:
        a = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "_", a).strip("_")[:100].strip("_") or "untitled"

    return s.map(one)


def parse_tags(raw: Column) -> Column:
    """Tags of a comma list, with or without brackets and quotes, blanks dropped."""
    bare = F.regexp_replace(F.trim(raw), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda t: F.regexp_replace(F.trim(t), r"""^["']|["']$""", "")), lambda t: t != "")


def tag_line(category: Column, tags: Column) -> Column:
    """Steps of a category and tags in one line, each once, in order."""
    return F.array_join(F.array_distinct(F.concat(F.filter(F.split(F.coalesce(category, F.lit("")), "/"), lambda x: x != ""), F.coalesce(tags, F.array().cast("array<string>")))), ", ")


def escape_scalar(value: Column) -> Column:
    """A value on one line, quotes and backslashes escaped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), r"\s*[\r\n]+\s*", " "), r"\\", r"\\\\"), '"', r'\\"')


def relevance(score: Column) -> Column:
    """A raw score (lower is better) as a relevance between 0 and 1."""
    x = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (score + SIGMOID_SHIFT) * SIGMOID_SLOPE))
    return 1 / (1 + F.exp(x))


def rank_relevance(rank: Column) -> Column:
    """Relevance of a document by its place from 0, when nothing was reranked."""
    return F.lit(0.75) / (1 + F.lit(0.12) * rank)


def chunk_relevance(document: Column, place: Column) -> Column:
    return F.greatest(F.lit(0.1), document * (1 - F.lit(0.1) * place))


def confidence_band(rel: Column, reranked: Column) -> Column:
    return F.when(reranked, F.when(rel >= HIGH_RELEVANCE, "high").when(rel >= MEDIUM_RELEVANCE, "medium").otherwise("low")).otherwise(F.when(rel >= MEDIUM_UNRANKED, "medium").otherwise("low"))


def snippet(text: Column, size: int = 200, reach: int = 40) -> Column:
    """About `size` characters: cut after the last sentence end near that, else at the last blank before, else hard."""
    t = F.trim(text)
    head = F.substring(t, 1, size + reach)
    at_sentence = F.regexp_extract(head, rf"(?s)^(.{{{size - reach},{size + reach - 1}}}[.!?])\s", 1)
    at_blank = F.regexp_extract(F.substring(t, 1, size + 20), r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(t) <= size, t).when(at_sentence != "", at_sentence).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(F.substring(t, 1, size)), F.lit("…")))


def metadata_lines(text: Column) -> Column:
    """Leading `**Key:** value` lines as a map."""
    lead = F.regexp_extract(text, r"(?s)^((?:\s*\*\*[^*\n]+:\*\*[^\n]*(?:\n|$))*)", 1)
    keys, values = F.regexp_extract_all(lead, F.lit(r"\*\*([^*\n]+):\*\*[ \t]*([^\n]*)"), 1), F.regexp_extract_all(lead, F.lit(r"\*\*([^*\n]+):\*\*[ \t]*([^\n]*)"), 2)
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.lit(True)))


def leading_metadata(text: Column) -> Column:
    """A text's leading `**Key:** value` lines and `[A > B]` breadcrumb: struct<content, metadata, breadcrumb>. Blank lines among
    them are skipped, the first other line starts the content; of repeated keys and breadcrumbs the last counts."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    pair = r"^\*\*([^*\n]+):\*\*\s*(.*)$"
    crumb = r"^\[(.*>.*)\]$"
    other = F.transform(lines, lambda x, i: F.when(~(F.trim(x).rlike(pair) | F.trim(x).rlike(crumb) | (F.trim(x) == "")), i))
    first = F.coalesce(F.array_min(other), F.size(lines))
    head = F.transform(F.slice(lines, F.lit(1), first), lambda x: F.trim(x))
    entries = F.transform(F.filter(head, lambda x: x.rlike(pair)), lambda x: F.struct(F.trim(F.regexp_extract(x, pair, 1)).alias("k"), F.trim(F.regexp_extract(x, pair, 2)).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"]))
    crumbs = F.filter(head, lambda x: x.rlike(crumb))
    content = F.trim(F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))), "\n"))
    return F.struct(F.regexp_replace(content, r"\A\s+|\s+\z", "").alias("content"), F.map_from_entries(last).alias("metadata"), F.trim(F.regexp_extract(F.try_element_at(crumbs, F.lit(-1)), crumb, 1)).alias("breadcrumb"))


def document_date(date: Column, modified: Column) -> Column:
    """A document's date: its own (as text), else the time it was changed."""
    return F.coalesce(F.nullif(F.trim(date), F.lit("")), modified.cast("string"))


# Spellings of true in settings.
TRUE_WORDS = ("1", "true", "yes")


def setting_bool(value: Column, default: bool = False) -> Column:
    """A setting as a boolean: the default if there is none, true for a spelling of true, else false."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(value).isin(*TRUE_WORDS))


def valid_category(category: Column, known: list[str], default: str | None = None) -> Column:
    """The category if it is a known one, the default where there is none, else an error that names the known ones."""
    c = F.coalesce(F.nullif(category, F.lit("")), F.lit(default or known[0]))
    return F.when(c.isin(*known), c).otherwise(F.raise_error(F.concat(F.lit("invalid category '"), c, F.lit("', must be one of: " + ", ".join(known)))))


# Prefixes that embedders of one family expect of queries and passages.
EMBEDDING_PREFIXES = {"multilingual-e5-base": ("query: ", "passage: ")}


def embedding_text(text: Column, model: str, passage: bool) -> Column:
    """What is embedded of a query or passage: with the prefix that the model's family expects."""
    prefix = next((p for name, p in EMBEDDING_PREFIXES.items() if name in model), ("", ""))[int(passage)]
    return F.concat(F.lit(prefix), text) if prefix else text


def phase_status(exit_code: Column) -> Column:
    """The state of a phase by its exit code: `skipped` as such, 0 succeeded, else failed."""
    return F.when(exit_code == "skipped", "skipped").when(exit_code.try_cast("int") == 0, "succeeded").otherwise("failed")


def contains_word(text: Column, word: Column) -> Column:
    """The word stands in the text as a whole word, whatever the case (all letters count as word characters)."""
    return F.rlike(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)")))


def md5_body(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def chunk_fingerprint(document: Column, chunk: Column) -> Column:
    """SHA-256 of document and chunk text, parted by a zero byte."""
    return F.sha2(F.concat(document.cast("binary"), F.lit("\0").cast("binary"), chunk.cast("binary")), 256)


# Patterns of the codes that documents mention.
ENTITY_PATTERNS = {
    "buc": r"(?iU)LA[_ ]?BUC[_ ]?(\d{1,2})",
    "sed_a": r"(?iU)\b(A\d{3})\b",
    "sed_x": r"(?iU)\b(X\d{3})\b",
    "article": r"(?iU)art(?:ikkel)?\.?\s*(\d{1,2})(?:\s*(?:nr\.?\s*)?(\d+))?",
    "regulation": r"(?iU)(?:forordning\s+)?(\d{3}/\d{4})\b",
    "issue": r"(?U)\b([A-Z][A-Z0-9]+-\d+)\b",
}


def entity_codes(text: Column, kind: str) -> Column:
    """Codes of one kind in a text, each once, upper-cased, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), 1), F.upper))


def entity_candidates(text: Column, kind: str) -> Column:
    """The nodes that the codes of one kind may name, in order: array<struct<span, ids>>. Of the ids of a code the first known
    one counts, but for articles, where both the article's part and the article count."""
    spans, codes = F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), 0), F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), 1)
    named = lambda prefix, x: F.concat(F.lit(prefix), x)
    if kind == "article":
        parts = F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), 2)
        pairs = F.zip_with(codes, parts, lambda a, p: F.when(F.coalesce(p, F.lit("")) != "", F.array(F.concat(F.lit("artikkel:"), a, F.lit("."), p), named("artikkel:", a))).otherwise(F.array(named("artikkel:", a))))
    else:
        ids = {
            "buc": lambda c: F.array(named("buc:LA_BUC_", F.lpad(c, 2, "0"))), "sed_a": lambda c: F.array(named("sed:", F.upper(c))), "sed_x": lambda c: F.array(named("sed:", F.upper(c))),
            "regulation": lambda c: F.array(named("forordning:", c)), "issue": lambda c: F.array(named("issue:", c), named("epic:", c)),
        }[kind]
        pairs = F.transform(codes, ids)
    return F.zip_with(spans, pairs, lambda s, i: F.struct(s.alias("span"), i.alias("ids")))


# Endings that make a "domain" a file name, domains of placeholders, and the signs of an address.
FILE_ENDINGS = "xsl xml xsd json yml yaml css js ts java kt py md txt htm html log".split()
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "test.com")
ADDRESS = rf"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.(?!(?:{'|'.join(FILE_ENDINGS)})\b)[a-zA-Z]{{2,}}\b)"


def email_addresses(text: Column) -> Column:
    """Addresses but for those at placeholder domains and file names."""
    return F.filter(F.regexp_extract_all(text, F.lit(ADDRESS), 1), lambda e: ~F.lower(F.element_at(F.split(e, "@"), -1)).isin(*PLACEHOLDER_DOMAINS))


def _checked(d: Column, weights: list[int]) -> Column:
    return sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0)) % 11 == 0


def is_national_id(digits: Column) -> Column:
    """Eleven digits with a day (or day + 40), a month and two check digits."""
    day, month = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    dated = (day.between(1, 31) | day.between(41, 71)) & month.between(1, 12)
    return digits.rlike(r"^\d{11}$") & dated & _checked(digits, [3, 7, 6, 1, 8, 9, 4, 5, 2, 1]) & _checked(digits, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1])


def national_ids(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?<![/#\d])\b(\d{11})\b"), 1), is_national_id)


def redact_unconditional(text: Column) -> Column:
    """Passwords named in a text, replaced."""
    return F.regexp_replace(text, r"(?i)((?:passord|password)\s*(?:er|is|:)\s*)(?!<redacted-password>)\S+", "$1<redacted-password>")


def line_of(text: Column, position: Column) -> Column:
    """The line (from 1) in which the character at a position (from 0) stands."""
    return F.size(F.split(F.substring(text, F.lit(1), position), "\n"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_seconds(clock: Column) -> Column:
    """`MM:SS` or `H:MM:SS` as seconds; null for anything else."""
    p = F.transform(F.split(clock, ":"), lambda x: x.try_cast("int"))
    return F.when(clock.rlike(r"^\d{1,3}(:\d{2}){1,2}$"), F.when(F.size(p) == 2, p[0] * 60 + p[1]).otherwise(p[0] * 3600 + p[1] * 60 + p[2]))


def page_id_of_url(url: Column) -> Column:
    """The last 32 hex digits of a page address."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, "-", ""), r"([0-9a-f]{32})/*(?:\?.*)?$", 1), F.lit(""))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([\w-]{11})", 1), F.lit(""))


def generic_title(title: Column) -> Column:
    """A title that names nothing: empty, `YouTube`, `Video`, `Untitled`, or a bare id."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return t.isin("", "youtube", "video", "untitled", "youtube video") | t.rlike(r"^(?:video\s+)?[\w-]{11}$") & t.rlike(r"\d")


def clean_command_text(text: Column) -> Column:
    """Session text without command and reminder elements."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<(command-[a-z]+|system-reminder|local-command-[a-z]+)>.*?</\1>", ""), r"\n{3,}", "\n\n"))


def percent(rel: Column) -> Column:
    return F.format_string("%d%%", F.bround(rel * 100).cast("int"))


# Words that make a question one of relations, and those that name what is asked for.
RELATION_WORDS = "hvilke which what hva inneholder contains inngår tilhører".split()
ASKED_WORDS = {
    "seds": "sed seder seds sedene".split(), "bucs": "buc bucer bucs bucene".split(), "articles": "artikkel article hjemmel hjemmelen".split(),
    "issues": "issues issue oppgaver oppgave saker sak tasks".split(), "epic": "epic epics".split(), "contains": "inneholder contains inngår tilhører".split(),
}


def relational_intent(text: Column) -> Column:
    """A question about relations."""
    return asks_for(text, RELATION_WORDS)


def asks_for(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(word_tokens(text), F.array(*[F.lit(w) for w in words]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(s: pd.Series) -> pd.Series:
    """Strings of a JSON array as models write it: fenced, with a trailing comma, or wrapped in an object. Null if there is none."""
    def one(t: str | None) -> list[str] | None:
        if not t:
            return None
        t = re.sub(r"^\s*```(?:json)?|```\s*$", "", t.strip()).strip()
        m = re.search(r"\[.*\]", t, re.S)
        for c in (t, m and m[0]):
            if not c:
                continue
            try:
                v = json.loads(re.sub(r",\s*([\]}])", r"\1", c))
            except ValueError:
                continue
            if isinstance(v, dict):
                v = next((x for x in v.values() if isinstance(x, list)), None)
            if isinstance(v, list):
                return [x if isinstance(x, str) else json.dumps(x) for x in v]
        return None

    return s.map(one)


def _bare(word: str) -> str:
    return word.lower().strip(WORD_SIGNS)


def broaden_query(q: str) -> tuple[str, str] | None:
    """A broader query and how it was found: the part before a conjunction, without trailing parentheses, without quotes, or
    without the last content word and the filler before it. The first way that applies decides; None if fewer than two words
    stay then. The plain twin of `broaden`."""
    q = q.strip()
    low = q.lower()
    for sep in CONJUNCTIONS:
        if low.find(sep) > 0:
            got, how = q[: low.find(sep)].strip(), "conjunction"
            return (got, how) if len(got.split()) > 1 else None
    m = re.search(r"\s*\([^)]*\)\s*$", q)
    words = q.split()
    last = max((i for i, w in enumerate(words) if _bare(w) and _bare(w) not in STOPWORDS), default=-1)
    if m and m.start():
        got, how = q[: m.start()].strip(), "parentheses"
    elif '"' in q and q.replace('"', "").strip():
        got, how = q.replace('"', "").strip(), "unquote"
    elif len(words) > 2 and last >= 0:
        rest = words[:last] + words[last + 1 :]
        while rest and _bare(rest[-1]) in STOPWORDS:
            rest.pop()
        got, how = " ".join(rest), "drop_word"
    else:
        return None
    return (got, how) if len(got.split()) > 1 else None


def broaden(query: Column) -> Column:
    """A broader query as struct<query, strategy>, or null; in Spark's own expressions. The rules of `broaden_query`, the
    strategies by their names in hints: conjunction_split, trailing_parens, unquote, drop_last_word."""
    q = F.trim(query)
    low = F.lower(q)
    option = lambda text, how: F.struct(F.trim(text).alias("query"), F.lit(how).alias("strategy"))
    out = None
    for sep in CONJUNCTIONS:
        at = F.instr(low, sep)
        out = F.when(at > 1, option(q.substr(F.lit(1), at - 1), "conjunction_split")) if out is None else out.when(at > 1, option(q.substr(F.lit(1), at - 1), "conjunction_split"))
    bare = F.regexp_replace(q, r"\s*\([^)]*\)\s*$", "")
    out = out.when((bare != q) & (F.trim(bare) != ""), option(bare, "trailing_parens"))
    unquoted = F.replace(q, F.lit('"'), F.lit(""))
    out = out.when((unquoted != q) & (F.trim(unquoted) != ""), option(unquoted, "unquote"))
    words = F.split(q, r"\s+")
    sign = "[" + re.escape(WORD_SIGNS) + "]+"
    plain = lambda w: F.regexp_replace(F.lower(w), f"^{sign}|{sign}$", "")
    filler = lambda w: plain(w).isin(sorted(STOPWORDS))
    last_where = lambda ws, test: F.array_max(F.transform(ws, lambda w, i: F.when(test(w), i)))
    last = last_where(words, lambda w: (plain(w) != "") & ~filler(w))
    rest = F.filter(words, lambda w, i: i != last)
    kept = F.slice(rest, F.lit(1), F.coalesce(last_where(rest, lambda w: ~filler(w)) + 1, F.lit(0)))
    out = out.when((F.size(words) > 2) & last.isNotNull(), option(F.array_join(kept, " "), "drop_last_word"))
    return F.when(F.size(F.split(out["query"], r"\s+")) > 1, out)

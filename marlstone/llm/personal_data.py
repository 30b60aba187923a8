"""Personal data in free text: found behind disguises, replaced by typed placeholders, every other character kept.

Transducers rewrite the text to a plain form (look-alike letters and digits, spelled digits, "at" and "dot") and record
from which source characters each stretch came; detectors read the plain form; spans are mapped back to the source.
Names of persons are told from other capitalised words by a naive Bayes model over word beginnings and endings,
trained on the name columns of the collection.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.plans import hash_sample, spread, with_fields

#: Bounds of the model's training sample: distinct names, and texts whose capitalised words stand for other words.
NAME_SAMPLE, TEXT_SAMPLE = 20_000, 4_000

# Letters and digits that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" "０１２３４５６７８９＠．＋－" "   ‐‑‒–−",
    "ABEKMHOPCTXaeopcyxijs" "ABEZHIKMNOPTYXo" "0123456789@.+-" "   -----",
)
# Digits spelled out.
DIGIT_WORDS = {w: str(n) for n, ws in enumerate(["zero oh null nul noll zéro cero", "one en ett ein eins un uno", "two to två zwei deux dos", "three tre drei trois tres", "four fire fyra vier quatre cuatro", "five fem fünf cinq cinco", "six seks sex sechs seis", "seven sju syv sieben sept siete", "eight åtte otte åtta acht huit ocho", "nine ni nio neun neuf nueve"]) for w in ws.split()}
#: Endings of files beside those that the plain detector knows.
FILE_ENDINGS = {*tx.FILE_ENDINGS, *"csv pdf png jpg jpeg gif svg zip gz tar sql sh doc docx xls xlsx ini cfg conf properties".split()}

_HIDDEN = re.compile("[​‌‍⁠﻿­]+")
_DIGITS = re.compile(rf"\b(?=[{''.join(sorted({w[0] for w in DIGIT_WORDS}))}])(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?:[ -]+(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")){5,}\b", re.I)
_LOCAL, _LABEL = r"[A-Za-z0-9_%+-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9_%+-]+)*", r"[A-Za-z0-9-]+"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt)\s?[)\]}]\s?|\s+dot\s+)"
_AT_MARKED = r"\s?[(\[{<]\s?(?:at|a|@|krøllalfa|snabela)\s?[)\]}>]\s?"
_AT_PLAIN = r"\s+at\s+"
_DISGUISED = re.compile(
    rf"(?<![\w.@])(?P<l>[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*)(?:(?P<m>{_AT_MARKED}|\s*@\s*)(?P<d>{_LABEL}(?:{_DOT}{_LABEL})+)|(?P<p>{_AT_PLAIN})(?P<e>{_LABEL}(?:\s*[(\[{{]?\s*dot\s*[)\]}}]?\s*{_LABEL})+|(?:{_LABEL}\.)+(?:example|test|invalid|com|org|net|no|se|dk|de|io|uk|eu)))\b",
    re.I,
)
_DOTS = re.compile(_DOT, re.I)
#: Any form of at that _DISGUISED knows.
_AT_ANY = re.compile(rf"@|{_AT_MARKED}|{_AT_PLAIN}", re.I)
_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])")
_ID = re.compile(r"(?<![\w/#])(?<!\d[.-])(\d{6})[ .-]?(\d{5})(?![\w])")
_LONG_DIGITS = re.compile(r"\d[\d ().-]{5,}\d")
_PHONE = re.compile(
    r"(?<![\w/#.+-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}"
    r"|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|\(0\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|(?:1[.-])?[2-9]\d{2}([.-])\d{3}\1\d{4}"
    r"|0\d{1,4}[ .-]\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|(?<=[Tt]lf[.:] )\d{2}(?: ?\d{2}){3}|(?<=[Tt]lf[.:] )\d{3} \d{2} \d{3}|[49]\d{2} \d{2} \d{3}|\d{2} \d{2} \d{2} \d{2}"
    r")(?![\w]|[.-]\d)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ]"
_TOWN = rf"(?:,?\s*(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s+{_CAP}[\w'’-]+|,\s*{_CAP}[\w'’-]+(?:\s+{_CAP}{{1,2}}\d{{1,2}}\s*\d{_CAP}{{2}})?)?"
_STREET = re.compile(
    rf"(?<![\w-])(?:{_CAP}[\w'’-]*[ \t]+){{0,2}}?{_CAP}[\w'’-]*(?i:gata|gaten|gate|gatan|veien|vegen|vei|veg|vägen|väg|bakken|backen|stien|stigen|gade|vejen|vej|stræde|allé|alleen|torget|torvet|straße|strasse|weg|platz)\s+\d{{1,4}}(?:\s?[A-Za-z](?![\w'’]))?(?![\w%]){_TOWN}"
    rf"|(?<![\w.,/#-])\d{{1,4}}\s?[A-Za-z]?[ \t]+(?:{_CAP}[\w'’-]*\.?[ \t]+){{1,3}}(?i:street|road|lane|avenue|drive|close|square|terrace|boulevard|crescent|st\.|rd\.|ave\.|ln\.|dr\.|blvd\.|st|rd|ave|ln)(?![\w-]){_TOWN}"
)
# Nouns whose number isn't a house number.
_LABEL_BEFORE = re.compile(r"(?i:figure|fig\.?|gate|table|room|platform|page|level|section|chapter|item|step|track|bus|line|terminal|slide|screen|version|part|exit|bay)\s+$")
_NUMBERED = re.compile(r"\d")
_TOKEN = re.compile(rf"(?<![\w@./+-]){_CAP}[^\W\d_]+(?:['’]{_CAP}?[^\W\d_]+)?(?:-{_CAP}[^\W\d_]+)?(?![\w@/+-]|\.\w)|(?<=@){_CAP}[^\W\d_]+(?:-{_CAP}[^\W\d_]+)?(?![\w@.])")
_TWO = re.compile(rf"{_CAP}[^\W\d_]+\s+(?:{_CAP}\.?\s+)?{_CAP}[^\W\d_]")
_LISTED = re.compile(rf"{_CAP}[^\W\d_]+, {_CAP}[^\W\d_]")
_BETWEEN = re.compile(rf"[ \t ]+(?:{_CAP}\.?[ \t]+){{0,2}}|[ \t]*\n")
WEIGHTS_1, WEIGHTS_2 = (3, 7, 6, 1, 8, 9, 4, 5, 2, 1), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1)


def plain(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text without disguises, and where it was rewritten: (plain start, plain end, source start, source end), in order."""
    folded = text if text.isascii() else text.translate(LOOKALIKES)
    found = []
    if not folded.isascii():
        found += [(m.start(), m.end(), "") for m in _HIDDEN.finditer(folded)]
    if _AT_ANY.search(folded):
        for m in _DISGUISED.finditer(folded):
            new = _DOTS.sub(".", m["l"]) + "@" + _DOTS.sub(".", m["d"] or m["e"])
            new = re.sub(r"\s", "", new)
            if new != m[0]:
                found.append((m.start(), m.end(), new))
    for m in _DIGITS.finditer(folded):
        found.append((m.start(), m.end(), "".join(DIGIT_WORDS[w.lower()] for w in re.split(r"[ -]+", m[0]))))
    if not found:
        return folded, []
    out, spans, at, size = [], [], 0, 0
    for a, b, new in sorted(found):
        if a < at:
            continue
        out += [folded[at:a], new]
        size += a - at
        spans.append((size, size + len(new), a, b))
        size += len(new)
        at = b
    return "".join(out) + folded[at:], spans


def source_span(spans: list[tuple[int, int, int, int]], start: int, end: int) -> tuple[int, int]:
    """The source characters of plain[start:end]; a rewritten stretch counts as a whole."""
    def back(p: int, last: bool) -> int:
        i = bisect.bisect_right(spans, (p - last, 1 << 60, 0, 0)) - 1
        if i < 0:
            return p
        a, b, c, d = spans[i]
        return (d if last else c) if a <= p - last < b else d + p - b

    return back(start, False), back(end, True)


def is_national_id(d: str) -> bool:
    n = [int(c) for c in d]
    day, month = int(d[:2]), int(d[2:4])
    return (1 <= day <= 31 or 41 <= day <= 71) and 1 <= month <= 12 and sum(a * b for a, b in zip(n, WEIGHTS_1)) % 11 == 0 and sum(a * b for a, b in zip(n, WEIGHTS_2)) % 11 == 0


class NameModel:
    """Naive Bayes over the beginnings and endings of words: given names, family names, other words."""

    def __init__(self, names: list[str], words: list[str]):
        """names: full names; words: different words of texts, of any kind."""
        given, family = Counter(), Counter()
        for n in names:
            t = [x for x in n.split() if len(x.rstrip(".")) > 1]
            if len(t) >= 2:
                for g in t[0].split("-"):
                    given[g.lower()] = 1
                for f in t[-1].split("-"):
                    family[f.lower()] = 1
        other = Counter({w: 1 for w in set(words) if w not in given and w not in family})
        self.words = {"g": frozenset(given), "f": frozenset(family)}
        self.counts = {k: Counter(f for w in c for f in self._features(w)) for k, c in (("g", given), ("f", family), ("o", other))}
        self.n = {"g": len(given), "f": len(family), "o": len(other)}
        self.memo: dict[tuple[str, str], float] = {}

    @staticmethod
    def _features(w: str) -> list[str]:
        return [f"^{w[:k]}" for k in (2, 3, 4)] + [f"{w[-k:]}$" for k in (2, 3, 4)]

    def score(self, word: str, kind: str) -> float:
        """Log odds that the word is a name of this kind and not another word."""
        w = word.lower()
        got = self.memo.get((w, kind))
        if got is None:
            got = max(self._one(p, kind) for p in [w]) if "-" not in w else min(self._one(p, kind) for p in w.split("-"))
            if len(self.memo) < 1_000_000:
                self.memo[w, kind] = got
        return got

    def _one(self, w: str, kind: str) -> float:
        own, other = self.counts[kind], self.counts["o"]
        s = sum(math.log((own[f] + 0.05) / (self.n[kind] + 1)) - math.log((other[f] + 0.05) / (self.n["o"] + 1)) for f in self._features(w))
        return s / 2 + (3 if w in self.words[kind] else 0)


def find(text: str, names: NameModel) -> list[tuple[str, int, int]]:
    """(type, start, end) in source characters, by position."""
    p, spans = plain(text)
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        found.append((kind, a, b))
        taken.append((a, b))

    def free(a: int, b: int) -> bool:
        return all(b <= c or d <= a for c, d in taken)

    skipped: list[tuple[int, int]] = []
    if "@" in p:
        for m in _EMAIL.finditer(p):
            domain = m[0].rsplit("@", 1)[1].lower()
            if domain in tx.PLACEHOLDER_DOMAINS or domain.rsplit(".", 1)[1] in FILE_ENDINGS:
                skipped.append(m.span())
            else:
                add("email", *m.span())
    if _NUMBERED.search(p):
        if _LONG_DIGITS.search(p):
            for m in _ID.finditer(p):
                if is_national_id(m[1] + m[2]):
                    add("national_id", *m.span())
            for m in _PHONE.finditer(p):
                if free(*m.span()) and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", *m.span())
            for a, b, _, _ in spans:  # spelled digits have no blanks; counting isn't a number
                d = p[a:b]
                if 8 <= len(d) <= 15 and d.isdecimal() and d not in "01234567890" and d not in "09876543210" and len(set(d)) > 1 and free(a, b):
                    add("phone", a, b)
        for m in _STREET.finditer(p):
            if free(*m.span()) and not _LABEL_BEFORE.search(p, max(0, m.start() - 12), m.start()):
                add("street_address", *m.span())
    if _TWO.search(p) or _LISTED.search(p):
        taken += skipped
        tokens = list(_TOKEN.finditer(p))
        i = 0
        while i + 1 < len(tokens):
            a, b = tokens[i], tokens[i + 1]
            gap = p[a.end() : b.start()]
            listed = gap == ", "  # family name first
            if (listed or _BETWEEN.fullmatch(gap)) and free(a.start(), b.end()):
                g, f = (names.score(b[0], "g"), names.score(a[0], "f")) if listed else (names.score(a[0], "g"), names.score(b[0], "f"))
                if g > 0 and f > 0 and g + f > 4:
                    add("person_name", a.start(), b.end())
                    i += 2
                    continue
            i += 1
    found.sort(key=lambda x: x[1])
    return [(k, *source_span(spans, a, b)) for k, a, b in found] if spans else found


def train_names(names: DataFrame, texts: DataFrame, id: list[str]) -> NameModel:
    """The model of a bounded sample: about NAME_SAMPLE distinct names, and the different words of about TEXT_SAMPLE whole
    texts, drawn by hash. names: a frame of one column; texts: the id columns, unique together, and text."""
    n = names.toDF("x").filter("x is not null").distinct()
    t = hash_sample(texts.filter("text is not null").select(*id, "text"), TEXT_SAMPLE, id)
    words = t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), 1)).alias("w")).distinct()
    return NameModel(sorted(r[0] for r in hash_sample(n, NAME_SAMPLE, ["x"]).collect()), sorted(r[0] for r in words.collect()))


def find_personal_data(df: DataFrame, text: str, keep: list[str], names: NameModel, redact: bool = True) -> DataFrame:
    """The spans of personal data in a text column, and the text with placeholders.

    Result: `keep`, spans array<struct<type, start, end, occurrence>> (characters from 0; occurrence from 1 by position
    within the row and type) and, with `redact`, redacted (each span replaced by <type>). Types: email, phone, national_id,
    street_address, person_name. A null text gives an empty array and a null; an empty one an empty text. Whole texts are
    read; rows are kept one to one, repeated ones too; other columns don't matter.
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.col(text).cast("string").alias("_text")))
    model = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            every, texts = [], []
            for t in b["_text"]:
                got = find(t, m) if t else []
                seen: Counter = Counter()
                row = []
                for kind, a, z in got:
                    seen[kind] += 1
                    row.append({"type": kind, "start": a, "end": z, "occurrence": seen[kind]})
                every.append(row)
                if redact:
                    out, at = [], 0
                    for kind, a, z in got:
                        out += [t[at:a], f"<{kind}>"]
                        at = z
                    texts.append(None if t is None else "".join(out) + t[at:])
            yield pd.DataFrame({"_keep": b["_keep"], "spans": every, **({"redacted": texts} if redact else {})})

    spans = "spans array<struct<type:string,start:int,end:int,occurrence:int>>"
    out = base.mapInPandas(run, with_fields(base.select("_keep").schema, spans + (", redacted string" if redact else "")))
    return out.select("_keep.*", "spans", *(["redacted"] if redact else []))

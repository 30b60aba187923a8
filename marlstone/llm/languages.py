"""Languages of texts and of their segments, by prediction with partial matching.

One context tree per language predicts each letter from up to four letters before it; where a context hasn't seen the letter,
an escape probability leads to the next shorter one. The code length of a segment under each language's frozen statistics
chooses its language, and the lead over the others gives the confidence. The trees are trained on a bounded sample of the
collection, of texts whose label agrees first with the list of frequent words, then with the trees themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans import hash_sample, spread, with_fields

ORDER = 4
#: Bounds of the training sample: texts drawn by hash, which are read whole, and letters of their segments, drawn at random, per language.
SAMPLE_TEXTS, SAMPLE_LETTERS = 4_000, 120_000
#: A segment counts with this many words and this lead in bits over the runner-up; an unbroken run of more than LONG words is cut every CHUNK
#: (its pieces need twice the lead, as they may straddle two languages).
WORDS, LEAD, LONG, CHUNK = 5, 14.0, 45, 15

# The letters of the model, after lower-casing; all else parts words, other letters share one sign.
LETTERS = " abcdefghijklmnopqrstuvwxyzåäöæøéèêëüßñçáàâãíìîïóòôõúùûýÿðþ"
# Names that labels give the languages.
LABELS = {
    "en": "en eng english engelsk engelska englisch anglais inglés ingles",
    "nb": "nb no nob nor norsk bokmål bokmal norwegian norwegisch norvégien noruego",
    "sv": "sv swe svenska swedish svensk schwedisch suédois sueco",
    "da": "da dan dansk danish danska dänisch danois danés",
    "de": "de deu ger deutsch german tysk tyska allemand alemán",
    "fr": "fr fra fre français francais french fransk franska französisch francés",
    "es": "es spa español espanol spanish castellano spansk spanska spanisch espagnol",
}

_CODE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|\{(?P<c>code|noformat)(?::[^}\n]*)?\}.*?(?:\{(?P=c)\}|\Z)|<(?P<t>pre|code|script|style|syntaxhighlight|nowiki|math)\b[^>]*>.*?</(?P=t)>"
    r"|\\begin\{(?P<b>[a-z*]+)\}.*?\\end\{(?P=b)\}|\$\$.*?\$\$|\$[^$\n]{1,200}\$|`[^`\n]+`|\{\{[^}\n]*\}\}|<!--.*?-->|</?[A-Za-z][^<>]{0,300}>|&#?\w{1,8};"
    r"|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*|!?\[[^\]\n]*\]\([^)\n]*\)|\[\[[^\]\n]*\]\]|\[[^\]|\n]*\|[^\]\n]*\]|![^\s!|]+(?:\|[^!\n]*)?!",
    re.S | re.I,
)
_SPELLED = re.compile(r"[^\s]+(?: dot [^\s]+)* at [^\s]+(?: dot [^\s]+)+")  # an address in words
_MARKS = re.compile(r"[`{<\\$\[!~&]")


def label_language(label: Column) -> Column:
    """The code of the language that a label names (any case, region, two or three letters, name), or null."""
    names = F.create_map(*[F.lit(x) for code, ws in LABELS.items() for w in ws.split() for x in (w, code)])
    return F.try_element_at(names, F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1))


def readable(text: str) -> str:
    """The text with code, markup and spelled addresses blanked out; every character keeps its place."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if _MARKS.search(text):
        text = _CODE.sub(blank, text)
    return _SPELLED.sub(blank, text) if " dot " in text else text


def technical(raw: np.ndarray) -> np.ndarray:
    """Bytes of words that are names, numbers or addresses: with a digit, one of _@/\\+ , a hyphen or dot between letters, or a capital inside."""
    n = len(raw)
    space, letter = _SPACE[raw], _CODES[raw] > 0
    low, big = letter & ~_BIG[raw], _BIG[raw]
    odd = _TECHNICAL[raw].copy()
    if n > 2:
        odd[1:-1] |= _JOINT[raw[1:-1]] & letter[:-2] & letter[2:]
        odd[1:] |= big[1:] & low[:-1]
    start = np.concatenate([[True], space[1:] != space[:-1]])
    first = np.nonzero(start)[0]
    hit = (np.add.reduceat(odd.view(np.uint8), first, dtype=np.int64) > 0) & ~space[first]
    return np.repeat(hit, np.diff(np.concatenate([first, [n]])))


def _byte_codes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = bytes([b]).decode("latin-1").lower()
        t[b] = LETTERS.index(c) if len(c) == 1 and c in LETTERS else (63 if c.isalpha() else 0)
    return t


_CODES = _byte_codes()
_END, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True
_BIG, _TECHNICAL, _JOINT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BIG[65:91] = _BIG[192:223] = True
_TECHNICAL[[ord(c) for c in "0123456789_@/\\+"]] = True
_JOINT[[ord("-"), ord(".")]] = True
_SPACE[[9, 10, 11, 12, 13, 32, 160]] = True


@dataclass
class Segments:
    """Segments of a batch of texts: letter codes with their segment, and each segment's text, start, end and words."""

    codes: np.ndarray
    first: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    plain_words: np.ndarray  # without those in title case, as names are
    pieces: np.ndarray  # cut out of a long unbroken run


def segments(texts: list[str]) -> Segments | None:
    """Sentences and lines of the texts; long unbroken runs are cut after every CHUNK words. None if no text has a letter."""
    clean = [readable(t) for t in texts]
    raw = np.frombuffer("".join(f"{t}\n" for t in clean).encode("latin-1", "replace"), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in clean])
    codes = np.where(technical(raw), 0, _CODES[raw]) if len(raw) else _CODES[raw]
    prev = np.concatenate([[np.uint8(10)], raw[:-1]])
    cut = (_SPACE[raw] & _END[prev]) | (raw == 10)
    seg = np.cumsum(cut) - cut  # the space itself still belongs to the segment before
    keep = (codes > 0) | (np.concatenate([[0], codes[:-1]]) > 0)  # one space after each word
    at = np.nonzero(keep)[0]
    if not len(at):
        return None
    big = _BIG[raw]
    title = (big & ~np.concatenate([big[1:], [False]]))[at]
    codes, seg = codes[at], seg[at]
    starts = (codes > 0) & np.concatenate([[True], (codes[:-1] == 0) | (seg[1:] != seg[:-1])])
    word = np.cumsum(starts)
    new = np.concatenate([[True], seg[1:] != seg[:-1]])
    head = np.nonzero(new)[0]
    base = word[head] - starts[head]
    count = np.diff(np.concatenate([base, [word[-1]]]))
    which = np.cumsum(new) - 1
    inner = np.where(count[which] > LONG, (word - base[which] - 1).clip(0) // CHUNK, 0)
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (inner[1:] != inner[:-1])])
    head = np.nonzero(new)[0]
    last = np.concatenate([head[1:], [len(at)]]) - 1
    text = np.searchsorted(ends, at[head], "right")
    offset = np.concatenate([[0], ends[:-1]])[text]
    return Segments(codes, head, text, at[head] - offset, at[last] - offset + (codes[last] > 0), np.add.reduceat(starts.astype(np.int64), head), np.add.reduceat((starts & ~title).astype(np.int64), head), (count > LONG)[which[head]])


def windows(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each letter with its four predecessors as 30 bits; a segment starts after a space."""
    w = codes.astype(np.uint32)
    out = w.copy()
    for k in range(1, ORDER + 1):
        shifted = np.zeros_like(w)
        shifted[k:] = w[:-k]
        for j in range(k):
            h = first + j
            shifted[h[h < len(w)]] = 0
        out |= shifted << np.uint32(6 * k)
    return out


@dataclass
class Model:
    """Frozen statistics: for each order the letters and contexts seen, with bits per language (NaN where a language hasn't seen them)."""

    langs: list[str]
    letters: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    cache: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "letters": self.letters, "contexts": self.contexts, "cache": {}}

    def bits(self, w: np.ndarray) -> np.ndarray:
        """Code lengths (windows x languages) of the last letter of each window after the ones before it."""
        total = np.zeros((len(w), len(self.langs)), np.float32)
        open_ = np.ones_like(total, bool)
        for k in range(ORDER, -1, -1):
            own = w & np.uint32((1 << (6 * (k + 1))) - 1)
            for keys, table, ends in ((own, self.letters[k], True), (own >> np.uint32(6), self.contexts[k], False)):
                at = np.searchsorted(table[0], keys).clip(max=len(table[0]) - 1)
                got = np.where((table[0][at] == keys)[:, None], table[1][at], np.nan)
                hit = open_ & ~np.isnan(got)
                total[hit] += got[hit]
                if ends:
                    open_ &= ~hit
        total[open_] += 6.0  # one of 64 signs
        return total

    def lengths(self, s: Segments) -> np.ndarray:
        """Code lengths in bits, segments x languages. The lengths of windows met before are kept by worker, as a cache only."""
        if not self.cache:
            self.cache.update(keys=np.full(1 << 22, 0xFFFFFFFF, np.uint32), rows=np.zeros(1 << 22, np.int32), bits=np.zeros((1 << 19, len(self.langs)), np.float32), n=0)
        c = self.cache
        w = windows(s.codes, s.first)
        slot = (w * np.uint32(2654435761)) >> np.uint32(10)
        miss = c["keys"][slot] != w
        if miss.any():
            new = np.unique(w[miss])
            if c["n"] + len(new) > len(c["bits"]):
                c["keys"][:] = 0xFFFFFFFF
                c["n"] = 0
                new = np.unique(w)
                if len(new) > len(c["bits"]):
                    return np.add.reduceat(self.bits(w), s.first, axis=0)
            c["bits"][c["n"] : c["n"] + len(new)] = self.bits(new)
            at = (new * np.uint32(2654435761)) >> np.uint32(10)
            c["keys"][at], c["rows"][at] = new, np.arange(c["n"], c["n"] + len(new))
            c["n"] += len(new)
        rows = c["rows"][slot]
        lost = c["keys"][slot] != w  # two windows of this batch share a slot
        got = c["bits"][rows]
        if lost.any():
            got[lost] = self.bits(w[lost])
        return np.add.reduceat(got, s.first, axis=0)


def fit(langs: list[str], parts: list[list[np.ndarray]]) -> Model:
    """The model of letter codes by language: each language's segments."""
    letters: list[dict[int, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    contexts: list[dict[int, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    for i, own in enumerate(parts):
        codes = np.concatenate(own) if own else np.zeros(1, np.uint8)
        first = np.cumsum([0] + [len(x) for x in own[:-1]]) if own else np.zeros(1, np.int64)
        w = windows(codes, first)
        for k in range(ORDER + 1):
            keys, counts = np.unique(w & np.uint32((1 << (6 * (k + 1))) - 1), return_counts=True)
            context, back = np.unique(keys >> np.uint32(6), return_inverse=True)
            n, kinds = np.bincount(back, counts), np.bincount(back)
            for x, bits in zip(keys.tolist(), -np.log2(counts / (n + kinds)[back])):
                letters[k].setdefault(x, np.full(len(langs), np.nan, np.float32))[i] = bits
            for x, bits in zip(context.tolist(), -np.log2(kinds / (n + kinds))):
                contexts[k].setdefault(x, np.full(len(langs), np.nan, np.float32))[i] = bits
    pack = lambda d: (np.array(sorted(d), np.uint32), np.array([d[x] for x in sorted(d)], np.float32))
    return Model(langs, [pack(d) for d in letters], [pack(d) for d in contexts])


def train(texts: DataFrame, id: list[str], common_words: DataFrame) -> Model:
    """The model of a bounded sample of `texts` (the id columns, unique together, text, lang): texts whose doubtful label agrees with the frequent words, then
    with the model so far. About SAMPLE_TEXTS texts are drawn by hash and read whole. common_words: lang, word."""
    t = texts.filter("text is not null").select(*id, F.col("text").alias("x"), label_language(F.col("lang")).alias("label"))
    rows = sorted(hash_sample(t, SAMPLE_TEXTS, id).select("x", "label").collect(), key=lambda r: (r[0], r[1] or ""))
    np.random.default_rng(0).shuffle(rows)
    sample, labels = [r[0] for r in rows], [r[1] for r in rows]
    pairs = common_words.select("lang", "word").distinct().collect()
    langs = sorted({r[0] for r in pairs})
    where: dict[str, set[int]] = {}
    for lang, word in pairs:
        where.setdefault(word.lower(), set()).add(langs.index(lang))
    own_words = [[np.concatenate([_CODES[np.frombuffer(w.lower().encode("latin-1", "replace"), np.uint8)], np.zeros(1, np.uint8)]) for k, w in pairs if k == lang] for lang in langs]
    s = segments(sample) if sample else None
    if s is None:
        return fit(langs, own_words)
    ends = np.concatenate([s.first[1:], [len(s.codes)]])
    pieces = [s.codes[a:b] for a, b in zip(s.first, ends)]
    votes = np.zeros((len(pieces), len(langs)))
    for i, p in enumerate(pieces):
        for w in "".join(LETTERS[c] if c < len(LETTERS) else "?" for c in p).split():
            for k in (ls := where.get(w, ())):
                votes[i, k] += 1 / len(ls)
    label = np.array([langs.index(x) if x in langs else -1 for x in labels])

    def choose(score: np.ndarray) -> list[list[np.ndarray]]:
        """Segments of the texts whose label agrees with the score of the whole text, but for those that speak for another language."""
        whole = np.zeros((len(sample), len(langs)))
        np.add.at(whole, s.text, score)
        agreed = whole.argmax(1) == label
        best = score.argmax(1)
        out = [list(x) for x in own_words]
        size = [0] * len(langs)
        for i in np.random.default_rng(0).permutation(np.nonzero(agreed[s.text] & (s.words >= 3))[0]):
            k = label[s.text[i]]
            if size[k] <= SAMPLE_LETTERS and score[i, k] >= score[i, best[i]]:
                out[k].append(pieces[i])
                size[k] += len(pieces[i])
        return out

    model = fit(langs, choose(votes))
    for _ in range(2):
        model = fit(langs, choose(-model.lengths(s)))
    return model


def _judge(model: Model, texts: list[str], with_segments: bool) -> tuple[list[list[dict]], list[list[dict]]]:
    found: list[list[dict]] = [[] for _ in texts]
    parts: list[list[dict]] = [[] for _ in texts]
    s = segments(texts)
    if s is None:
        return found, parts
    bits = model.lengths(s)
    n, k = len(bits), len(model.langs)
    best = bits.argmin(1)
    order = np.partition(bits, 1, axis=1)
    lead = order[:, 1] - order[:, 0]
    total = np.zeros((len(texts), k))
    np.add.at(total, s.text, bits * (s.words >= 2)[:, None])
    letters = np.bincount(s.text, s.words, len(texts))
    main = total.argmin(1)
    over = bits[np.arange(n), main[s.text]] - bits[np.arange(n), best]  # against the text's main language
    sure = (s.words >= WORDS) & (s.plain_words >= WORDS - 1) & (lead >= np.where(s.pieces, 2 * LEAD, LEAD)) & (over >= np.where(best == main[s.text], 0, LEAD))
    share = np.zeros((len(texts), k))
    np.add.at(share, (s.text[sure], best[sure]), s.words[sure])
    p_seg = 1 / np.exp2(-(bits - order[:, :1])).sum(1)
    belief = np.zeros((len(texts), k))
    np.add.at(belief, (s.text[sure], best[sure]), (p_seg * s.words)[sure])
    for t in np.nonzero(letters)[0]:
        own = np.nonzero(share[t])[0]
        if len(own):
            every = share[t].sum()
            found[t] = [{"lang": model.langs[j], "share": float(share[t, j] / every), "confidence": float(belief[t, j] / share[t, j])} for j in own[np.argsort(-share[t, own], kind="stable")]]
        elif total[t].max() > 0:
            gap = total[t] - total[t].min()
            found[t] = [{"lang": model.langs[main[t]], "share": 1.0, "confidence": float(1 / np.exp2(-gap).sum())}]
    if with_segments:
        for i in np.nonzero(s.words)[0]:
            parts[s.text[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "lang": model.langs[best[i]], "confidence": float(p_seg[i]), "sure": bool(sure[i])})
    return found, parts


def identify_languages(df: DataFrame, text: str, keep: list[str], model: Model, with_segments: bool = False) -> DataFrame:
    """The languages of each text and, with `with_segments`, of its segments.

    Result: `keep`, n_words (runs between blanks), languages array<struct<lang, share of the judged words, confidence>>,
    the largest share first, and segments array<struct<start, end, lang, confidence, sure>> (characters from 0). A language
    is named if a segment of at least five words is surely in it; else the text as a whole is judged. Code, markup,
    addresses and technical names aren't judged. Null, empty and letterless texts have no language; rows stay one to one.
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.col(text).cast("string").alias("_text")))
    shared = df.sparkSession.sparkContext.broadcast(model)
    part = "array<struct<start:int,end:int,lang:string,confidence:double,sure:boolean>>"
    schema = with_fields(base.select("_keep").schema, "n_words int, languages array<struct<lang:string,share:double,confidence:double>>" + (f", segments {part}" if with_segments else ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                texts = [t or "" for t in b["_text"]]
                found, parts = _judge(m, texts, with_segments)
                yield pd.DataFrame({"_keep": b["_keep"].reset_index(drop=True), "n_words": [len(t.split()) for t in texts], "languages": found, **({"segments": parts} if with_segments else {})})

    return base.mapInPandas(run, schema).select("_keep.*", "n_words", "languages", *(["segments"] if with_segments else []))

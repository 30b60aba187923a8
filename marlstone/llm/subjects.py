"""Subject areas of texts: one-versus-rest linear classifiers over hashed word n-grams, read sentence by sentence.

Clean examples train a first model. It tells what the values of section metadata and address paths usually stand for; these
weak labels bring many more sentences, on which the final model is trained. Held-out texts, alone and mixed, calibrate the score
a sentence of a text needs to count for a class, and the share of its sentences that makes a subject of a text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import hash_sample, spread, with_fields

#: Hashed features, bound of the weakly labelled sample (texts, read whole), and passes over it.
BITS, SAMPLE_TEXTS, EPOCHS = 18, 6_000, 6
#: The share of a text's sentences that makes a subject (calibrated around it), and the sentences a second subject needs.
SHARE, LEAST_SENTENCES = 0.25, 2
#: A metadata value is a weak label if the first model gives one subject this share of those of its texts that it gives any
#: (texts in other languages have none).
WEAK_SHARE = 0.5
#: The least share of a subject in a text before its sentences are read, and the rounds in which sentences and shares are fitted.
PRIOR, ROUNDS = 0.02, 3
#: The share and the score of sentences about none of the subjects.
NONE, NONE_SCORE = 0.1, -4.5
#: The share of a text's sentences that must speak for its weak label.
SPEAKING = 0.25
#: Differences of F1 that don't tell two thresholds apart.
F1_TIE = 0.002
PIECE_WORDS, LONG_WORDS = 14, 40

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Addresses: their letters are no words.
_ADDRESS = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\S+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+")
_MASK = (1 << BITS) - 1


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh32_intdigest(w)
        if len(self) < 2_000_000:
            self[w] = h
        return h


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence or line, without addresses; unbroken runs are cut into pieces of about a sentence."""
    out = []
    for s in _SENTENCE.split(_ADDRESS.sub(" ", text) if "/" in text or "@" in text or "www." in text else text):
        w = _WORD.findall(s.lower())
        if len(w) > LONG_WORDS:
            n = max(1, round(len(w) / PIECE_WORDS))
            cuts = [len(w) * i // n for i in range(n + 1)]
            out += [w[a:b] for a, b in zip(cuts, cuts[1:])]
        elif len(w) >= 3:
            out.append(w)
    return out


def features(rows: list[list[str]], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of each row, flat, and where each row starts."""
    n = np.array([len(r) for r in rows], np.int64)
    one = np.array([ids[w] for r in rows for w in r], np.uint64)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    two = np.empty_like(one)
    two[1:] = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B)
    two[start] = one[start] * np.uint64(0xC2B2AE3D)  # the first word has no predecessor: marked as first
    both = np.stack([one, two ^ (two >> np.uint64(29))], 1).ravel()
    return (both & np.uint64(_MASK)).astype(np.int64), start * 2


class Model:
    """Weights per hashed feature and class, biases, the score a sentence of a text needs to count for a class, and the share
    of a text's sentences that makes a subject."""

    def __init__(self, classes: list[str]):
        self.classes = classes
        self.w = np.zeros((1 << BITS, len(classes)), np.float32)
        self.b = np.full(len(classes), -2.0, np.float32)
        self.threshold = np.zeros(len(classes))
        self.share = SHARE

    def scores(self, rows: list[list[str]], ids: _Ids) -> np.ndarray:
        f, start = features(rows, ids)
        size = np.diff(np.concatenate([start, [len(f)]]))
        return np.add.reduceat(self.w[f], start, axis=0) / np.sqrt(size)[:, None] + self.b

    def train(self, rows: list[list[str]], y: np.ndarray, ids: _Ids, epochs: int = EPOCHS, rate: float = 0.5) -> None:
        """Logistic one-versus-rest regression by adaptive gradient steps; y: rows x classes of 0 and 1."""
        order = np.random.default_rng(0)
        square = np.full_like(self.w, 1e-2)
        for _ in range(epochs):
            mix = order.permutation(len(rows))
            for at in range(0, len(mix), 256):
                pick = mix[at : at + 256]
                f, start = features([rows[i] for i in pick], ids)
                size = np.diff(np.concatenate([start, [len(f)]]))
                z = np.add.reduceat(self.w[f], start, axis=0) / np.sqrt(size)[:, None] + self.b
                g = 1 / (1 + np.exp(-z)) - y[pick]
                self.b -= rate * 0.1 * g.mean(0)
                own = np.repeat(g / np.sqrt(size)[:, None], size, axis=0).astype(np.float32)
                keys, back = np.unique(f, return_inverse=True)
                step = np.zeros((len(keys), len(self.classes)), np.float32)
                np.add.at(step, back, own)
                square[keys] += step * step
                self.w[keys] -= rate * step / np.sqrt(square[keys])

    def in_texts(self, z: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
        """Log odds that a sentence is about a class and not about another one or none, in its text: words that several
        subjects use are read as the text's other sentences suggest, whose shares weigh the classifiers' probabilities."""
        k = len(self.classes)
        prior, none = np.full((texts, k), 1.0 / k), NONE / (1 + np.exp(-NONE_SCORE))
        n = np.maximum(np.bincount(of, minlength=texts), 1)[:, None]
        p = np.exp(-np.logaddexp(0, -np.clip(z.astype(np.float64), -30, 30)))
        for _ in range(ROUNDS):
            q = p * prior[of]
            q /= q.sum(1, keepdims=True) + none
            total = np.zeros((texts, k))
            np.add.at(total, of, q)
            prior = (total + PRIOR * n) / (n * (1 + PRIOR * k))
        q = np.clip(p * prior[of] / ((p * prior[of]).sum(1, keepdims=True) + none), 1e-12, 1 - 1e-12)
        return np.log(q) - np.log1p(-q)

    def calibrate(self, texts: list[tuple[list[list[str]], np.ndarray]], ids: _Ids) -> None:
        """Per class the threshold of best F1 for the sentences of held-out texts (sentences, the class of each), then the
        share of best F1 for the classes that hold at least SHARE of a text's sentences."""
        flat, truth = [x for t, _ in texts for x in t], np.concatenate([y for _, y in texts]) if texts else np.zeros(0, int)
        if not flat:
            return
        of = np.repeat(np.arange(len(texts)), [len(t) for t, _ in texts])
        s = self.in_texts(self.scores(flat, ids), of, len(texts))
        for k in range(len(self.classes)):
            own = truth == k
            if not own.any():
                continue
            order = np.argsort(-s[:, k], kind="stable")
            hit = np.cumsum(own[order])
            f1 = 2 * hit / (np.arange(1, len(order) + 1) + own.sum())
            at = s[order, k]
            below = np.append(at[1:], at[-1] - 2)
            good = f1 >= f1.max() - F1_TIE  # of thresholds as good, the one nearest to even odds
            cut = np.clip(0.0, below[good] + 1e-9, at[good] - 1e-9)
            self.threshold[k] = cut[np.abs(cut).argmin()]
        shares, _ = self.shares(s, of, len(texts))
        held = np.zeros_like(shares)
        np.add.at(held, (of, truth), 1)
        wanted = held >= SHARE * held.sum(1, keepdims=True)
        grid = np.arange(0.10, 0.41, 0.01)
        f1 = [2 * (wanted & (shares >= g)).sum() / max(1, wanted.sum() + (shares >= g).sum()) for g in grid]
        near = np.nonzero(np.array(f1) >= max(f1) - 1e-9)[0]
        self.share = float(grid[near[np.abs(grid[near] - SHARE).argmin()]])

    def shares(self, s: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts x classes: the share of the sentences with a subject that count for each, and their number. A sentence counts
        for every class whose threshold it reaches."""
        counts = np.zeros((texts, len(self.classes)))
        t, k = np.nonzero(s > self.threshold)
        np.add.at(counts, (of[t], k), 1)
        n = np.bincount(of[np.unique(t)], minlength=texts)[:, None]
        return counts / np.maximum(n, 1), counts


def judge(model: Model, texts: list[str], ids: _Ids) -> list[list[dict]]:
    """The subjects of each text: subject, share of its sentences, sentences, the largest share first."""
    parts = [sentences(t) for t in texts]
    flat = [s for p in parts for s in p]
    out: list[list[dict]] = [[] for _ in texts]
    if not flat:
        return out
    of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    shares, counts = model.shares(model.in_texts(model.scores(flat, ids), of, len(texts)), of, len(texts))
    for i in np.nonzero(counts.any(1))[0]:
        order = np.argsort(-counts[i], kind="stable")
        got = [j for r, j in enumerate(order) if r == 0 or (r == 1 and shares[i, j] >= model.share and counts[i, j] >= LEAST_SENTENCES)]
        out[i] = [{"subject": model.classes[j], "share": float(counts[i, j] / len(parts[i])), "sentences": int(counts[i, j])} for j in got]
    return out


def mixtures(texts: list[tuple[list[list[str]], int]]) -> list[tuple[list[list[str]], np.ndarray]]:
    """Held-out texts of one class each, alone and with a part of a text of another class behind them."""
    rng, out = np.random.default_rng(1), []
    for i in rng.permutation(len(texts)):
        a, x = texts[i]
        b, y = texts[int(rng.integers(len(texts)))]
        n = min(len(b), int(round(len(a) * rng.choice([0.0, 0.1, 0.5, 1.0])))) if x != y else 0
        out.append((a + b[:n], np.array([x] * len(a) + [y] * n)))
    return out


def sections(*values: str | list | None) -> list[str]:
    """Comparable values of section metadata and address paths: lower-cased, without "category:", each path step too."""
    out = []
    for v in values:
        for x in v if isinstance(v, (list, np.ndarray)) else [v]:
            if not x:
                continue
            x = re.sub(r"^\s*category\s*:\s*", "", str(x).lower()).strip()
            if "://" in x:
                x = re.sub(r"^[a-z]+://[^/]*", "", x)
                out += [f"path:{s}" for s in re.split(r"[/?=&#]", x) if re.fullmatch(r"[a-z-]{2,30}", s)]
            elif x:
                out.append(x)
    return out


def train(examples: DataFrame, rows: DataFrame, id: list[str], metadata: list[str]) -> Model:
    """The model of the clean examples (subject, text; a small fixed table) and of a bounded sample of `rows` (id columns,
    unique together, text, and the metadata columns): about SAMPLE_TEXTS texts drawn by hash."""
    clean = [(r[0], r[1]) for r in examples.select("subject", "text").filter("subject is not null and text is not null").collect()]
    classes = sorted({c for c, _ in clean})
    ids = _Ids()
    x0 = [(classes.index(c), s) for c, t in clean for s in sentences(t)]
    one_hot = lambda ks: np.eye(len(classes), dtype=np.float32)[ks]
    first = Model(classes)
    if not x0:
        return first
    first.train([s for _, s in x0], one_hot([c for c, _ in x0]), ids, epochs=20)
    own = hash_sample(rows.filter("text is not null and text <> ''"), SAMPLE_TEXTS, id)
    sample = sorted((r["text"], sections(*[r[m] for m in metadata])) for r in own.select("text", *metadata).collect())
    guess = judge(first, [t for t, _ in sample], ids)
    votes: dict[str, Counter] = defaultdict(Counter)
    for (_, labels), g in zip(sample, guess):
        for v in set(labels) if g else ():
            votes[v][g[0]["subject"]] += 1
    meaning = {v: c.most_common(1)[0][0] for v, c in votes.items() if sum(c.values()) >= 5 and c.most_common(1)[0][1] >= WEAK_SHARE * sum(c.values())}
    x, y, held = [s for _, s in x0], [c for c, _ in x0], []
    for i, ((t, labels), g) in enumerate(zip(sample, guess)):
        weak = {meaning[v] for v in labels if v in meaning}
        if len(weak) != 1 or not g or g[0]["subject"] not in weak or len(g) > 1:
            continue  # a label that the text itself contradicts, or of a text on two subjects
        k = classes.index(g[0]["subject"])
        own_s = sentences(t)
        if own_s:
            z = first.scores(own_s, ids)
            # sentences that speak clearly for another subject are strays; texts of which no sentence speaks for this one are in another language
            kept = [s for s, v in zip(own_s, z) if v[k] >= v.max() - 1.0] if (z[:, k] > 0).mean() >= SPEAKING else []
            if i % 5 == 4 and kept:
                held.append((kept, k))
            else:
                x += kept
                y += [k] * len(kept)
    model = Model(classes)
    model.train(x, one_hot(y), ids)
    model.calibrate(mixtures(held), ids)
    return model


def assign_subjects(df: DataFrame, text: str, keep: list[str], model: Model) -> DataFrame:
    """The subjects of each text: `keep` and subjects array<struct<subject, share, sentences>>, one or two, the largest first.

    Null, empty and wordless texts have none; rows stay one to one; other columns don't matter.
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.col(text).cast("string").alias("_text")))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, ids = shared.value, _Ids()
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                yield pd.DataFrame({"_keep": b["_keep"].reset_index(drop=True), "subjects": judge(m, [t or "" for t in b["_text"]], ids)})

    return base.mapInPandas(run, with_fields(base.select("_keep").schema, "subjects array<struct<subject:string,share:double,sentences:int>>")).select("_keep.*", "subjects")

"""The extended Golay code [24, 12, 8]: every 24-bit word is within distance 4 of a codeword.

Used as a hash: a word's nearest codewords (by the weight of the bits that would have to flip) are the keys of a segment,
so two segments that differ in a few unsure bits still share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the cyclic code [23, 12, 7].
GENERATOR = 0b110001110101


def _encode(message: int) -> int:
    rest = message << 11
    for i in range(11, -1, -1):
        if rest >> (i + 11) & 1:
            rest ^= GENERATOR << i
    word = message << 11 | rest
    return word << 1 | (word.bit_count() & 1)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: up to six error patterns of least weight (padded with the first); the syndromes of both halves' bits."""
    def syndrome(word: int) -> int:  # the check bits of the message part against those there are
        return (_encode(word >> 12) ^ word) & 0xFFF

    unit = [syndrome(1 << b) for b in range(24)]
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(24), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            have = found.setdefault(s, [])
            if not have or have[0].bit_count() == weight:
                have.append(sum(1 << b for b in bits))
    errors = np.array([(found[s] * 6)[:6] if len(found[s]) < 6 else found[s][:6] for s in range(4096)], np.int32)
    low, high = np.zeros(4096, np.int32), np.zeros(4096, np.int32)
    for w in range(4096):
        for b in range(12):
            if w >> b & 1:
                low[w] ^= unit[b]
                high[w] ^= unit[b + 12]
    return errors, np.stack([low, high])


def nearest(soft: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest codewords' indices (0..4095) of each row of `soft` (n x 24, the sign is the bit, the size its sureness).

    Words that flip any of the three least sure bits are decoded too, so the distance counts unsure bits less.
    Fewer distinct codewords than `count` are padded with -1.
    """
    errors, half = _tables()
    n = len(soft)
    size = np.abs(soft).astype(np.float32)
    word = ((soft > 0).astype(np.float32) @ (2.0 ** np.arange(24)).astype(np.float32)).astype(np.int32)
    weak = np.argpartition(size, 3, axis=1)[:, :3]
    flips = np.zeros((n, 8), np.int32)
    for k in range(8):
        for j in range(3):
            if k >> j & 1:
                flips[:, k] ^= np.int32(1) << weak[:, j].astype(np.int32)
    tried = word[:, None] ^ flips
    error = errors[half[0][tried & 0xFFF] ^ half[1][tried >> 12]]  # n x 8 x 6
    error = (error ^ flips[:, :, None]).reshape(n, -1)
    index = (word[:, None] ^ error) >> 12
    # the weight of a pattern: four lookups of 6 bits in the row's own tables
    table = (size.reshape(-1, 6) @ ((np.arange(64)[None, :] >> np.arange(6)[:, None]) & 1).astype(np.float32)).ravel()
    at, base = error.astype(np.intp), (np.arange(n) * 256)[:, None]
    loss = sum(table.take(base + (64 * q) + (at >> (6 * q) & 63)) for q in range(4))
    out, rows = np.full((n, count), -1, np.int64), np.arange(n)
    for k in range(count):  # a codeword taken isn't taken again
        best = loss.argmin(1)
        own = index[rows, best]
        out[:, k] = np.where(np.isinf(loss[rows, best]), -1, own)
        loss[index == own[:, None]] = np.inf
    return out

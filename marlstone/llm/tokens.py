"""Token counts and token offsets under a public tokenizer's vocabulary, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder of the vocabulary files, and the file used.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern of these vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(folder, vocabulary)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)


def token_starts(text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Where each token starts, in characters, and the length of the text at the end. A token that starts inside a
    character is counted at that character."""
    e = encoding(folder, vocabulary)
    sizes = np.array([len(b) for b in e.decode_tokens_bytes(e.encode_ordinary(text))], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
    starts = np.concatenate([chars - 1, [len(text)]])
    return starts[at]

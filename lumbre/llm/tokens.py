"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of a byte-level BPE as lines of base64 token and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Largest vocabulary file that is sent to the executors, in bytes.
LARGEST = 64 << 20


def _parsed(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoding(path: str):
    with open(path, "rb") as f:
        return _parsed(f.read())


@lru_cache(maxsize=4)
def _encoding_of(data: bytes):
    return _parsed(data)


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have none. The vocabulary is read
    by the driver and broadcast, so executors need no file; one of more than
    ``LARGEST`` bytes raises."""
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"{path} is too large to be sent to the executors")
    with open(path, "rb") as f:
        held = SparkSession.active().sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding_of(held.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    return count(text)

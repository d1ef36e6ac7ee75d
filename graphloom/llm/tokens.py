"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # unless spark.graphloom.vocabulary names another; every executor reads it

# Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of the whole text; a null or empty text has none."""
    session = SparkSession.getActiveSession()
    vocabulary = vocabulary or (session and session.conf.get("spark.graphloom.vocabulary", None)) or VOCABULARY

    @F.pandas_udf("bigint")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return sizes(text)

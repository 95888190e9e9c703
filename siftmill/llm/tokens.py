"""Sizes of texts in tokens of a public tokenizer (a byte-level BPE vocabulary given as ranks)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary is unless said otherwise.
VOCABULARY = os.environ.get("SIFTMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's makers divide a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[int, object] = {}


def encoder(ranks: bytes):
    """The encoder of a vocabulary file's bytes, made once per Python worker."""
    key = hash(ranks)
    if key not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _loaded[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def token_count(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of a text; null for null. The vocabulary (below 1 MB) is read on the driver and broadcast."""
    with open(vocabulary or VOCABULARY, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks.value).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return run(text)


def sized(df: DataFrame, key: str, text: str, extra: list[str], latest: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """key, extra and tokens of every row with a text; of re-delivered keys the latest row. Texts are not shuffled."""
    at = [latest] if latest else []
    counted = df.select(key, *extra, *at, token_count(df.sparkSession, F.col(text), vocabulary).alias("tokens")).filter(f"tokens is not null and {key} is not null")
    order = F.struct(*(F.col(c) for c in at), F.col("tokens"))
    return counted.groupBy(key).agg(F.max_by(F.struct(*extra, "tokens"), order).alias("r")).select(key, "r.*")

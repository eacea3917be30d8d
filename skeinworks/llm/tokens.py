"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file's path is a parameter; every Python worker loads it once.
Texts are encoded whole.  Only a very long run of white space, which the split
pattern's engine cannot take, is cut out: the pattern matches such a run, but for
the last sign before other text, in one piece, so the sum of the parts is exact.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
# Fixed value: the customary split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space signs of a run that is encoded by itself.
LONG_RUN = 10_000


@cache
def _encoder(vocabulary: str):
    tiktoken = importlib.import_module("tiktoken")
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _long_run(least: int) -> regex.Pattern[str]:
    return regex.compile(rf"\p{{White_Space}}{{{least},}}")


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of one text; 0 for NULL and empty."""
    if not text:
        return 0
    encoder, total, at = _encoder(vocabulary), 0, 0
    if len(text) >= LONG_RUN:
        for run in _long_run(LONG_RUN).finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
            at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def counter(vocabulary: str = VOCABULARY) -> Callable:
    @F.pandas_udf("long")
    def token_count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([count(t, vocabulary) for t in s], dtype="int64")

    return token_count


def with_token_count(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows and ``n_tokens`` of their ``text``."""
    return df.withColumn("n_tokens", counter(vocabulary)("text"))

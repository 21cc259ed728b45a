"""Sizes of texts in tokens of a public tokenizer, whose files are read from a folder given as a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = 200_000  # characters encoded at once


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Tokens of a text; a very long one is encoded in pieces cut before a space that a word follows, where the
    pattern cuts too."""
    if not text:
        return 0
    enc, n, at = encoding(path), 0, 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalpha()):
                end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_counts(df: DataFrame, row_id: str, text: str, keep: tuple[str, ...] = (), folder: str | None = None, ranks: str = RANKS) -> DataFrame:
    """(row_id, *keep, n_tokens). A null or empty text has 0 tokens."""
    path = os.path.join(folder or FOLDER, ranks)
    kinds = dict(df.dtypes)
    columns = list(dict.fromkeys([row_id, *keep]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[columns].copy()
            out["n_tokens"] = [count(t, path) for t in f["_text"]]
            yield out

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "n_tokens bigint"])
    return df.select(*columns, F.col(text).alias("_text")).mapInPandas(run, schema)

"""Token counts by a public tokenizer. Its files are read where they lie; the folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# How this vocabulary splits a text before merging: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Table (id, tokens) of documents (id, text) with their other columns, each text encoded whole. A null text
    has 0 tokens. The table is written, as several steps read it."""
    path = f"{folder}/{vocabulary}"
    others = [c for c in documents.columns if c != "text"]
    schema = documents.select(*others).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield b.select(others).append_column("tokens", pa.array(n, pa.int64()))

    return cut(documents.mapInArrow(run, schema), "tokens")


def keyed(df: DataFrame, seed: int) -> DataFrame:
    """With ``key``, a random number of 63 bits that depends on the id alone."""
    return df.withColumn("key", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1))

"""Sizes of texts in tokens of a public tokenizer; its vocabulary file is a parameter and is sent to the executors."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text, 0 for an empty one and null for null. Special tokens' names are ordinary text.

    Only the driver needs the file: executors get a copy with the session's files.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext.addFile(vocabulary)

    def run(column: pa.Array) -> pa.Array:
        sent = SparkFiles.get(os.path.basename(vocabulary))
        encode = encoding(sent if os.path.exists(sent) else vocabulary).encode_ordinary
        return pa.array([None if s is None else len(encode(s)) for s in column.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(text)

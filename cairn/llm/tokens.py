"""Encoding a corpus with a public tokenizer through tiktoken and a local rank file.

The rank file is read once by the driver and sent to the executors as a broadcast (a fixed
835 kB), so no executor needs the file or a network.  A long text is cut
where the splitting pattern always begins a new piece, before one space between two
visible characters, so the ids of the parts are the ids of the whole and no call
gets an unbounded text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a part; a text without a safe boundary is one part of any length.
PART = 50_000
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_ENCODINGS: dict[int, object] = {}


def read_ranks(path: str = RANK_FILE) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoding(ranks: bytes):
    """The tokenizer of a rank file's bytes, built once in each Python worker."""
    key = hash(ranks)
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, tokenizer) -> list[int]:
    """Ids of a text; none for null and the empty text.  Names of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= PART:
        return tokenizer.encode_ordinary(text)
    return [i for part in parts(text) for i in tokenizer.encode_ordinary(part)]


def decode(ids: list[int], tokenizer) -> str:
    """The text of its ids, by raw bytes: a character's bytes may lie in several ids."""
    return b"".join(tokenizer.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """(key, ids) of every row; a null or empty text has an empty list.  Other columns are not read.

    No shuffle: each Arrow batch is encoded where it is read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    source = docs.select(F.col(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            ids = [encode(t, tokenizer) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, ids array<int>")


def token_counter(spark: SparkSession, rank_file: str = RANK_FILE):
    """A Column function: the number of ids of a text, 0 for null and the empty text."""
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))

    def count(texts: pd.Series) -> pd.Series:
        tokenizer = encoding(ranks.value)
        return pd.Series([len(encode(t, tokenizer)) for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def decoded(ids: DataFrame, key: str = "doc_id", rank_file: str = RANK_FILE) -> DataFrame:
    """(key, text) of (key, ids); the inverse of ``encoded`` but for null, which comes back empty."""
    ranks = ids.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(lists: pd.Series) -> pd.Series:
        tokenizer = encoding(ranks.value)
        return pd.Series([None if x is None else decode([int(i) for i in x], tokenizer) for x in lists], dtype=object)

    return ids.select(key, F.pandas_udf(run, "string")("ids").alias("text"))

"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import small_batches

#: Texts above this many code points are cut at safe boundaries before they are encoded.
PIECE_POINTS = 100_000
# Before white space that follows something else a token always ends, and what stands before does not look past it.
_SAFE = regex.compile(r"(?<=[^\s])(?=\s)")


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoding of a rank file; loaded once in a Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, points: int = PIECE_POINTS) -> Iterator[str]:
    """The text in pieces of about ``points`` code points, cut only where the tokens of both sides do not change.

    Where no such place follows, as within one endless word, the piece goes on to the next place or to the end.
    """
    start = 0
    while len(text) - start > points:
        cut = _SAFE.search(text, start + points)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def packed_ids(text: str, enc: tiktoken.Encoding) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    if len(text) <= PIECE_POINTS:
        return np.asarray(enc.encode_ordinary(text), "<u4").tobytes()
    return b"".join(np.asarray(enc.encode_ordinary(piece), "<u4").tobytes() for piece in safe_pieces(text))


def encoded_batches(batches: Iterator[pa.RecordBatch], enc: tiktoken.Encoding, decoded: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and, if asked for, decoded of batches with doc_id and text, in batches of few bytes."""
    for batch in small_batches(batches):
        ids = [packed_ids(text or "", enc) for text in batch.column("text").to_pylist()]
        out = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())}
        if decoded:
            out["decoded"] = pa.array([_raw_bytes(packed, enc) for packed in ids], pa.binary())
        yield pa.RecordBatch.from_pydict(out)


def _encoded(docs: DataFrame, path: str, pattern: str, decoded: bool) -> DataFrame:
    schema = "doc_id long, ids binary" + ", decoded binary" * decoded
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda batches: encoded_batches(batches, encoding(path, pattern), decoded), schema)


def _raw_bytes(packed: bytes, enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(np.frombuffer(packed, "<u4").tolist())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` of every whole text, the ids packed as little-endian unsigned 32-bit integers.

    No special tokens: their strings are ordinary text. Null and empty texts give no ids. Other columns of ``docs`` are not read;
    repeated rows are encoded each. ``path`` must be readable by the executors.
    """
    return _encoded(docs, path, pattern, False)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode`` with a column ``decoded``: the raw bytes that the ids stand for, in one pass of one Python worker."""
    return _encoded(docs, path, pattern, True)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Raw bytes of packed ids; no ids give no bytes, null gives null. The bytes of ids cut anywhere need not be whole characters."""

    @F.pandas_udf("binary")
    def run(packed: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return packed.map(lambda x: None if x is None else _raw_bytes(x, enc))

    return run(ids)

"""Blocks of documents that meet in buckets of keys.

Counting over the whole corpus here never moves a row per word. Documents are dealt by a hash of their id into
blocks of about ``block_bytes``; a block sends each bucket (a range of 64-bit keys) one message with its own
sorted distinct keys and what it knows of them, and gets one reply in the same order. So a key that a third
of all documents hold arrives once from each block, whatever its number of rows. Messages are compressed
arrays. Replies find their block by a join on its number; the blocks' exchange is used again for each pass.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

MESSAGE = "bucket int, block int, kind int, payload binary"
BLOCK_BYTES = 8 << 20


def pack(**arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(payload: bytes) -> dict:
    if payload[:1] == b"{":  # numbers that Spark itself has summed
        return json.loads(payload)
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers (not negative) in the smallest type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def number_of_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")).first()["b"] or 0
    return max(1, -(-int(size) // block_bytes))


def in_blocks(docs: DataFrame, blocks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``block, doc_id, text`` and the columns to carry as ``carry0`` and so on. Rows without an id are dealt by their text."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(17), F.col("text"))).otherwise(F.xxhash64(F.lit(17), F.col("doc_id")))
    text = F.col("text").cast("string")
    return docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)])


def bucket_bits(blocks: int) -> int:
    """Buckets are a power of two, about as many as blocks: a bucket then holds about as many keys as a block."""
    return max(1, (blocks - 1).bit_length())


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted 64-bit keys that go to each bucket."""
    if not len(keys):
        return
    which = (keys >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for a, b in zip(head, np.append(head[1:], len(which)), strict=True):
        yield int(which[a]), slice(int(a), int(b))


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = [("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def received(table: pa.Table) -> list[tuple[int, int, int, dict]]:
    """(bucket, block, kind, arrays) by kind, bucket and block: the order of arrival has no effect."""
    rows = zip(*(table[c].to_pylist() for c in ("bucket", "block", "kind", "payload")), strict=True)
    return [(b, k, i, unpack(p)) for b, k, i, p in sorted(rows, key=lambda r: (r[2], r[0], r[1]))]

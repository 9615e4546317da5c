"""Words of whole texts as flat numpy arrays.

Everything here works on one Arrow batch of texts. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, so no UTF-8 sequence is ever cut. A batch is encoded once: ``codes`` holds, for
each word, its place in ``vocab``; per-word work (lower-casing, hashing, features) is then done once
for each distinct word. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.memory import settle

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text handled at once inside a task. Temporary arrays are a few times this.
CHUNK_BYTES = 8 << 20

U64 = np.uint64


@dataclass
class Words:
    """Words of ``n_docs`` texts. ``first[i]:first[i + 1]`` are the words of text i."""

    codes: np.ndarray  # int32, of each word
    vocab: list[bytes]  # the distinct words
    first: np.ndarray  # int64, n_docs + 1
    start: np.ndarray  # byte offset of each word in the batch
    end: np.ndarray
    text_at: np.ndarray  # byte offset of each text, n_docs + 1

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, joined, and where each begins (n + 1 offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    raw, at = utf8(texts)
    solid = ~SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = solid[heads]
    start = np.flatnonzero(begins)
    csum = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=csum[1:])
    offs = np.append(csum[start], csum[-1])
    end = start + np.diff(offs)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw[solid]))])
    coded = packed.dictionary_encode()
    vocab = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    if lower:
        to: dict[bytes, int] = {}
        remap = np.fromiter((to.setdefault(w.lower(), len(to)) for w in vocab), np.int32, len(vocab))
        codes, vocab = remap[codes] if len(codes) else codes, list(to)
    return Words(codes, vocab, np.searchsorted(start, at), start, end, at)


def hashes(vocab: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in vocab), U64, len(vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the usual xor-shift multiply finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def window_hashes(word_hash: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of k words, by doubling: O(n log k). Runs cross texts; mask those."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, width = None, 0, word_hash, 1
    rest = k
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * U64(base) + part)
            done += width
        rest >>= 1
        if rest:
            power = mix(power[:-width] * U64(base ^ width) + power[width:])
            width *= 2
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text (one longer text makes a slice)."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            settle()
            i = j

"""Substring dedup by windows that meet in groups of their prefixes.

Only repeats of at least ``width`` words are asked for, so no suffix tree is built: of the suffixes that begin at each word, the
nodes at depth ``width`` are all that counts, and a window is such a node. They are found in two levels, and kept only while
two documents share them:

1. A window of ``width`` words holds ``width - PREFIX + 1`` runs of PREFIX words; the run with the least hash
   is the window's prefix group. Equal windows fall into the same group, and about one run in sixteen is such a
   head, so this level is small. A group within one document can't hold a repeat: none of its windows goes on.
2. Windows of the other groups are named by the hash of their ``width`` words, with the least document id that holds
   each. A window that a smaller document holds too is a repeat; overlapping ones join to maximal stretches, whose
   words are removed.

Equality of words and windows is equality of 64-bit hashes. Groups are dealt by hash ranges into buckets, and a block of documents
sends a window once with its least id, so a passage that a third of all documents share weighs no more than the number of blocks.

Null and empty texts have no words. Rows without an id keep their words and are no source. Rows that repeat an
id are not repeats of each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.llm.blocks import MESSAGE, bucket_bits, in_blocks, messages, number_of_blocks, pack, received, slices
from tessera.llm.memory import settled
from tessera.llm.store import table
from tessera.llm.words import Words, hashes, window_hashes, words_of

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
NO_ID = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class Suffixes:
    """The windows of one block of documents: their group, and on demand their node."""

    def __init__(self, group: pa.Table, width: int):
        self.width = width
        self.texts = group["text"].combine_chunks()
        ids = group["doc_id"].combine_chunks()
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.w: Words = words_of(self.texts)
        vocab = hashes(self.w.vocab)
        self.word = vocab[self.w.codes] if len(self.w.codes) else np.zeros(0, np.uint64)
        self.prefix = max(1, min(20, width // 2))
        n = len(self.word) - width + 1
        self.begin = np.zeros(0, np.int64)
        if n > 0:
            doc = self.w.doc_of_word()
            self.begin = np.flatnonzero((doc[:n] == doc[width - 1 :]) & (self.ids[doc[:n]] != NO_ID))
            self.doc = self.ids[doc[self.begin]]
            heads = sliding_min(window_hashes(self.word, self.prefix), width - self.prefix + 1)
            self.head = heads[self.begin]
        else:
            self.doc, self.head = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted groups, whether two documents of this block share each, and the group of each window."""
        key, of = np.unique(self.head, return_inverse=True)
        low, high = np.full(len(key), NO_ID), np.full(len(key), -NO_ID)
        np.minimum.at(low, of, self.doc)
        np.maximum.at(high, of, self.doc)
        return key, low < high, of

    def nodes(self, shared: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes at full depth below shared groups: sorted names, least id here, windows, node of each window."""
        at = np.flatnonzero(shared[of])
        path = window_hashes(self.word, self.width)[self.begin[at]] if len(at) else np.zeros(0, np.uint64)
        key, of = np.unique(path, return_inverse=True)
        low = np.full(len(key), NO_ID)
        np.minimum.at(low, of, self.doc[at])
        return key, low, at, of


def replies(got: list, kind: int, size: int) -> np.ndarray:
    """The bits of a kind of reply, in the order in which the keys were sent."""
    parts = [np.unpackbits(x["bits"], count=x["n"]) for _, _, k, x in got if k == kind]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    assert len(out) == size, "a reply is missing"
    return out


def remove_repeats(docs: DataFrame, width: int = 50, blocks: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` (the kept words, joined by spaces) of every row.

    Columns named in ``carry`` come along as ``carry0`` and so on.
    """
    blocks = blocks or number_of_blocks(docs)
    bits = bucket_bits(blocks)
    dealt = in_blocks(docs, blocks, carry)
    extra = [f"carry{i}" for i in range(len(carry))]
    result = StructType([*StructType.fromDDL(RESULT).fields, *(dealt.schema[c] for c in extra)])

    def send_groups(key: tuple, group: pa.Table) -> pa.Table:
        names, _, _ = Suffixes(group, width).groups()
        return messages([(b, key[0].as_py(), 1, pack(keys=names[s])) for b, s in slices(names, bits)])

    def meet_groups(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        every, count = np.unique(np.concatenate([x["keys"] for *_, x in got]), return_counts=True)
        twice = every[count > 1]
        return messages([(b, k, 1, pack(n=len(x["keys"]), bits=np.packbits(np.isin(x["keys"], twice, assume_unique=True)))) for b, k, _, x in got])

    def send_nodes(key: tuple, group: pa.Table, answered: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        s = Suffixes(group, width)
        names, shared, of = s.groups()
        path, low, _, _ = s.nodes(shared | replies(received(answered), 1, len(names)), of)
        return messages([(b, key[0].as_py(), 2, pack(keys=path[c], low=low[c])) for b, c in slices(path, bits)])

    def meet_nodes(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        every, of = np.unique(np.concatenate([x["keys"] for *_, x in got]), return_inverse=True)
        low = np.full(len(every), NO_ID)
        np.minimum.at(low, of, np.concatenate([x["low"] for *_, x in got]))
        out, a = [], 0
        for b, k, _, x in got:
            own = low[of[a : a + len(x["keys"])]]
            out.append((b, k, 2, pack(n=len(own), bits=np.packbits(own < x["low"]))))
            a += len(x["keys"])
        return messages(out)

    def cut(key: tuple, group: pa.Table, answered: pa.Table) -> pa.Table:
        s, got = Suffixes(group, width), received(answered)
        names, shared, of = s.groups()
        path, low, at, node = s.nodes(shared | replies(got, 1, len(names)), of)
        gone = s.begin[at[replies(got, 2, len(path))[node] | (s.doc[at] > low[node])]] if len(at) else at
        cover = np.zeros(len(s.word) + 1, np.int32)
        cover[gone] += 1
        np.subtract.at(cover, np.minimum(gone + width, len(s.word)), 1)
        covered = np.cumsum(cover)[:-1] > 0
        out: tuple[list, list, list] = ([], [], [])
        raw = s.texts.fill_null("")
        for d in range(s.w.n_docs):
            a, b = int(s.w.first[d]), int(s.w.first[d + 1])
            own = covered[a:b]
            if own.all():
                kept = b""
            elif own.any():
                text, base = raw[d].as_py().encode(), int(s.w.text_at[d])
                kept = b" ".join([text[i:j] for i, j in zip((s.w.start[a:b][~own] - base).tolist(), (s.w.end[a:b][~own] - base).tolist(), strict=True)])
            else:
                kept = b" ".join(raw[d].as_py().encode().split())
            out[0].append(int(own.sum()))
            out[1].append(hashlib.sha256(kept).hexdigest())
            out[2].append(kept.decode())
        return pa.table({"doc_id": group["doc_id"], "n_words": pa.array(s.w.counts(), pa.int64()), "n_removed": pa.array(out[0], pa.int64()), "kept_sha256": pa.array(out[1], pa.string()), "kept": pa.array(out[2], pa.string()), **{c: group[c] for c in extra}})

    by_block = dealt.groupBy("block")
    first = by_block.applyInArrow(settled(send_groups), MESSAGE).groupBy("bucket").applyInArrow(settled(meet_groups), MESSAGE)
    second = by_block.cogroup(first.groupBy("block")).applyInArrow(settled(send_nodes), MESSAGE).groupBy("bucket").applyInArrow(settled(meet_nodes), MESSAGE)
    return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(settled(cut), result)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")

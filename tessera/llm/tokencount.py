"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is one flat array of symbol ids with the ends of its sequences marked. In each
round every sequence applies its own lowest-rank pair, all sequences at once; only pairs beside a merge
get a new rank. Sequences without a pair left are counted and leave the array, so that a round costs
what is still open. White space never joins two pre-tokens, so a text's count is the sum over its words,
and a batch merges each distinct word once.

Nulls and empty texts have 0 tokens. Repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.store import table
from tessera.llm.words import chunks, utf8, words_of

NONE = np.int64(1 << 40)
WHITE = re.compile(r"\s")  # all of Unicode's


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE gives each byte: printable bytes keep theirs, the rest follow from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in kept else chr(256 + n)
        n += b not in kept
    return out


class ArrayMerger:
    """BPE by ragged arrays. ``add(pre_tokens)`` gives the number of symbols that survive in each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters])
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters])
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        rank, made = np.arange(len(keys)), np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, at = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = np.append(keys, np.int64((1 << 62))), np.append(rank[at], NONE), np.append(made[at], 0)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        out = np.zeros(len(pre_tokens), np.int64)
        raw = np.frombuffer(b"".join(pre_tokens), np.uint8)
        if not len(raw):
            return out
        filled = np.flatnonzero(size)
        size = size[filled]
        final = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[final] = self.last[raw[final]]
        seq = np.repeat(np.arange(len(size)), size)
        rank, made = self._pairs(sym, seq)
        owner = filled
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(seq)))
            open_ = low < NONE
            out[owner[~open_]] = length[~open_]
            if not open_.all():  # counted ones leave
                keep = np.repeat(open_, length)
                sym, rank, made, owner, length, low = sym[keep], rank[keep], made[keep], owner[open_], length[open_], low[open_]
                seq = np.repeat(np.arange(len(owner)), length)
                if not len(sym):
                    break
            hit = rank == np.repeat(low, length)
            chained = hit[1:] & hit[:-1]
            if chained.any():  # like "aaa": every other pair of a run, from its left end
                index = np.arange(len(hit))
                run_at = np.where(hit & ~np.r_[False, hit[:-1]], index, 0)
                hit &= (index - np.maximum.accumulate(run_at)) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = made[at]
            rank[at] = -1  # to be ranked anew, as is the pair before
            before = at[at > 0] - 1
            rank[before] = -1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, made, seq = sym[keep], rank[keep], made[keep], seq[keep]
            stale = np.flatnonzero(rank < 0)
            joined = stale[(stale + 1 < len(sym))]
            joined = joined[seq[joined] == seq[joined + 1]]
            rank[stale] = NONE
            rank[joined], made[joined] = self.ranked(sym[joined], sym[joined + 1])
        return out

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside], made[inside] = self.ranked(sym[inside], sym[inside + 1])
        return rank, made


class WordCounter:
    """Tokens of distinct words. Normalising and splitting follow the tokenizer file's own rules."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        model = json.loads(spec)["model"]
        self.library = Tokenizer.from_str(spec)
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = ArrayMerger(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def pre_tokens(self, word: str) -> list[bytes]:
        """The bytes of each pre-token of one word that holds no special string."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()]
        text = self.library.normalizer.normalize_str(word)
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, vocab: list[bytes]) -> np.ndarray:
        extra = np.zeros(len(vocab), np.int64)
        owner: list[int] = []
        pieces: list[bytes] = []
        rest, texts = [], []
        for i, raw in enumerate(vocab):
            if raw.isalpha():  # of bytes: ASCII letters only
                owner.append(i)
                pieces.append(raw.lower())
            elif b"<|" in raw:
                self._special(i, raw.decode("utf-8", "replace"), owner, pieces, extra)
            else:
                word = raw.decode("utf-8", "replace")
                if WHITE.search(word):  # such as U+00A0: becomes a space, and would shift the words after it
                    own = self.pre_tokens(word)
                    owner += [i] * len(own)
                    pieces += own
                else:
                    rest.append(i)
                    texts.append(word)
        for at in range(0, len(rest), 2000):
            self._split(rest[at : at + 2000], texts[at : at + 2000], owner, pieces)
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(p, len(index)) for p in pieces), np.int64, len(pieces))
        if not owner:
            return extra
        return extra + np.bincount(owner, self.merger.count(list(index))[which], len(vocab)).astype(np.int64)

    def _special(self, i: int, word: str, owner: list[int], pieces: list[bytes], extra: np.ndarray) -> None:
        parts = [word]
        for special in self.special:  # each stands for one token
            split = [p.split(special) for p in parts]
            extra[i] += sum(len(s) - 1 for s in split)
            parts = [x for s in split for x in s]
        for part in filter(None, parts):
            own = self.pre_tokens(part)
            owner += [i] * len(own)
            pieces += own

    def _split(self, index: list[int], words: list[str], owner: list[int], pieces: list[bytes]) -> None:
        """Many words without white space in one call of the library: they are joined by spaces, which no pre-token crosses."""
        text = self.library.normalizer.normalize_str(" ".join(words))
        sizes = [len(w) + 1 for w in text.split(" ")]
        if len(sizes) != len(words):  # the words do not line up
            for i, word in zip(index, words):
                own = self.pre_tokens(word)
                owner += [i] * len(own)
                pieces += own
            return
        got = self.library.pre_tokenizer.pre_tokenize_str(text)
        at = np.searchsorted(np.cumsum(sizes), [a for _, (a, _) in got], "right")
        owner += np.array(index)[at].tolist()
        pieces += [p.encode() if p.isascii() else bytes(map(self.byte_of.__getitem__, p)) for p, _ in got]


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` of every row. The tokenizer file (a few MB, fixed) goes along with the task."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(spec.value)
        for batch in chunks(batches, "text", 24 << 20):
            w = words_of(batch.column("text"))
            per_word = np.append(0, np.cumsum(counter.count(w.vocab)[w.codes])) if len(w.codes) else np.zeros(1, np.int64)
            _, at = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(np.diff(per_word[w.first]))], ["id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

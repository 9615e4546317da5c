"""Benchmark decontamination by the q-gram lemma.

Texts and items are reduced to lower-case letters and digits (other bytes of UTF-8 letters stay). An item of
m letters that occurs with at most k edits (k = ``edit_rate`` m) shares at least m + 1 - q - k q of its q-grams with
the place, all on diagonals at most k apart. Shared q-grams are counted in bands of 2k + 1 diagonals that overlap by half,
regions that reach the bound are kept, and each is verified by alignment on its own diagonals and k more to each side. Items
with so few letters that k edits could touch all their q-grams take shorter ones (8, 4, 2 or 1).

A place's hits are first counted in sliding windows of the text alone: where no window can reach the lowest
bound, nothing is looked up. Items with fewer than q letters have no edits and are found exactly. All exact places of a
region are reported, else its best one. Items are broadcast in blocks
of at most ``block_bytes``; a larger benchmark takes another pass for each block.

Null and empty texts or items match nothing. Rows that repeat are reported each; items that repeat are
reported under each id. Extra columns are ignored. Offsets are UTF-8 bytes of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.store import broadcast, table
from tessera.llm.words import chunks, utf8

SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def letter_map() -> np.ndarray:
    """Each byte's letter; 0 for what is left out."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            out[b] = ord(chr(b).lower()) if b < 0x80 else b
    return out


LETTERS = letter_map()


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, each one's byte offset, where each text begins among the letters and among the bytes."""
    raw, at = utf8(texts)
    kept = LETTERS[raw]
    if len(raw):  # capital Latin-1 letters, in two bytes
        two = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        kept[1:][two] += 0x20
    place = np.flatnonzero(kept)
    return kept[place], place, np.searchsorted(place, at), at


def grams(letters: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q letters; exact up to 8 letters."""
    n = len(letters) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = letters.astype(np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    if q == 8:
        return four[:-4] | (four[4:] << np.uint64(32))
    out = np.zeros(n, np.uint64)
    for i in range(0, q - 3, 4):
        out = out * np.uint64(0x9E3779B97F4A7C15) + four[i : i + n]
    for i in range(q - q % 4, q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
    return out * np.uint64(0xBF58476D1CE4E5B9)


def aligned(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Least edits (at most k) that turn a stretch of the text into the item: edits, begin, end of the stretch.

    text is the band: the stretch may begin and end anywhere in it.
    """
    found = ends_of(item, text)
    best = int(found.min())
    if best > k:
        return None
    end = int(np.flatnonzero(found == best)[-1])
    back = ends_of(item[::-1], text[:end][::-1])
    return best, end - int(np.flatnonzero(back == best)[0]), end


FAR = 1 << 30


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, start: np.ndarray) -> np.ndarray:
    """Least edits on each diagonal low..high (place in the text less place in the item) with the whole item used. ``start``: costs
    before its first letter. Only these diagonals are computed."""
    diagonals = np.arange(low, high + 1)
    pad = np.zeros(max(0, -low), np.uint8), np.zeros(max(0, high + len(item) - len(text)), np.uint8)
    text = np.concatenate([pad[0], text, pad[1]])  # no letter is 0
    shift, ends = len(pad[0]), len(text) - len(pad[0]) - len(pad[1])
    ramp = np.arange(len(diagonals))
    row = start.astype(np.int64)
    for i, c in enumerate(item, 1):
        own = text[i + low - 1 + shift : i + high + shift]
        step = row + (own != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        row[(i + diagonals < 0) | (i + diagonals > ends)] = FAR
    return row


def aligned(item: np.ndarray, text: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edits (at most k) that turn a stretch of the text into the item: edits, begin, end of the stretch.

    The alignment stays on the diagonals low - k to high + k.
    """
    low, high = low - k, high + k
    diagonals = np.arange(low, high + 1)
    found = banded(item, text, low, high, np.where((diagonals >= 0) & (diagonals <= len(text)), 0, FAR))
    best = int(found.min())
    if best > k:
        return None
    end = int(diagonals[np.flatnonzero(found == best)[-1]]) + len(item)
    # back from that end: the first row's diagonals cost the letters of text they skip
    back = np.arange(-k, k + 1)
    found = banded(item[::-1], text[:end][::-1], -k, k, np.where(back >= 0, back, FAR))
    return best, end - len(item) - int(back[np.flatnonzero(found == best)[0]]), end


def edits(letters: int, edit_rate: float) -> int:
    return int(letters * edit_rate + 1e-9)


def gram_length(letters: int, edit_rate: float, q: int) -> int:
    """The longest of q, 8, 4, 2 and 1 with which k edits leave one q-gram at least: q (k + 1) <= letters. Items without edits take q."""
    k = edits(letters, edit_rate)
    return next((x for x in (q, 8, 4, 2) if x <= q and x * (k + 1) <= letters), 1) if k else q


@dataclass
class Matcher:
    """Items of one gram length."""

    ids: list[int]
    items: list[np.ndarray]
    edit_rate: float
    q: int

    def __post_init__(self) -> None:
        self.k = [edits(len(i), self.edit_rate) for i in self.items]
        long = [n for n, i in enumerate(self.items) if len(i) >= self.q]
        self.short = [n for n, i in enumerate(self.items) if 0 < len(i) < self.q]
        parts = [(grams(self.items[n], self.q), n) for n in long]
        gram = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(g), n) for g, n in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.gram >> np.uint64(42)] = True
        self.least = min((self.bound(n) for n in long), default=1)
        self.span = max((len(self.items[n]) + self.k[n] for n in long), default=0)
        self.size = np.array([len(i) for i in self.items])
        self.edits = np.array(self.k)
        self.bounds = np.array([self.bound(n) for n in range(len(self.items))])

    def bound(self, n: int) -> int:
        return len(self.items[n]) + 1 - self.q - self.k[n] * self.q

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, start, end, edits) of the best verified place of each item in each region."""
        letters, place, first, at = letters_of(texts)
        found = self.regions(letters, first)
        out = []
        for doc, n, low, high in found:
            item, k = self.items[n], self.k[n]
            a, b = max(int(first[doc]), low - k), min(int(first[doc + 1]), high + len(item) + k)
            base, own, want = int(at[doc]), letters[a:b], item.tobytes()
            places, p = [], (held := own.tobytes()).find(want)
            while p >= 0:
                places.append((0, p, p + len(item)))
                p = held.find(want, p + 1)
            got = None if places else aligned(item, own, k, low - a, high - a)
            for least, s, e in [got] if got else places:
                out.append((doc, self.ids[n], int(place[a + s]) - base if e > s else 0, int(place[a + e - 1]) + 1 - base, least))
        whole = None
        for n in self.short:
            whole = letters.tobytes() if whole is None else whole
            want, p = self.items[n].tobytes(), whole.find(self.items[n].tobytes())
            while p >= 0:
                doc = int(np.searchsorted(first, p, "right")) - 1
                if p + len(want) <= first[doc + 1]:
                    out.append((doc, self.ids[n], int(place[p] - at[doc]), int(place[p + len(want) - 1] + 1 - at[doc]), 0))
                p = whole.find(want, p + 1)
        return sorted(set(out))

    def regions(self, letters: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        g = grams(letters, self.q)
        hit = self.maybe[g >> np.uint64(42)]
        at = np.flatnonzero(hit)
        slot = np.searchsorted(self.gram, g[at])
        slot[slot == len(self.gram)] = 0
        same = self.gram[slot] == g[at] if len(self.gram) else np.zeros(len(at), bool)
        at = at[same]
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + self.q <= first[doc + 1]
        at = at[inside]
        if not len(at):
            return []
        # a window of span letters must hold the lowest bound of hits
        dense = np.searchsorted(at, at + self.span, "left") - np.searchsorted(at, at - self.span, "right") >= self.least
        at = at[dense]
        if not len(at):
            return []
        doc = np.searchsorted(first, at, "right") - 1
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        times = hi - lo
        who = np.repeat(lo - np.append(0, np.cumsum(times))[:-1], times) + np.arange(times.sum())
        item, diagonal = self.item[who], np.repeat(at, times) - self.place[who]
        doc, pos = np.repeat(doc, times), np.repeat(at, times)
        half = self.edits[item] + 1
        out = set()
        base = np.int64(diagonal.min())
        spread = int(diagonal.max() - base) + 2
        for shift in (0, 1):  # two grids of bands, half a band apart, cover every run of 2k + 1 diagonals at most k wide
            band = (diagonal - base + shift * half) // (2 * half)
            key = (doc * len(self.items) + item) * np.int64(spread + 2) + band
            order = np.argsort(key, kind="stable")
            key_s = key[order]
            head = np.flatnonzero(np.r_[True, key_s[1:] != key_s[:-1]])
            count = np.diff(np.append(head, len(key_s)))
            some = order[head]
            good = np.flatnonzero(count >= self.bounds[item[some]])
            for j in good.tolist():
                members = order[head[j] : head[j] + count[j]]
                n, d = int(item[members[0]]), int(doc[members[0]])
                out.add((d, n, int(diagonal[members].min()), int(diagonal[members].max())))
        # bands of one place: their diagonals are aligned together
        merged: list[tuple[int, int, int, int]] = []
        for d, n, low, high in sorted(out):
            if merged and merged[-1][:2] == (d, n) and low <= merged[-1][3] + 2 * self.k[n]:
                merged[-1] = (d, n, merged[-1][2], max(high, merged[-1][3]))
            else:
                merged.append((d, n, low, high))
        return merged


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_bytes`` (one larger item makes a block). They are read a row at a time."""
    out: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where("item_id is not null and length(text) > 0").select("item_id", "text").orderBy("item_id").toLocalIterator():
        more = len(r["text"].encode())
        if out and size + more > block_bytes:
            yield out
            out, size = [], 0
        out.append((r["item_id"], r["text"]))
        size += more
    if out:
        yield out


def matchers(benchmark: DataFrame, edit_rate: float, q: int, block_bytes: int) -> Iterator[Matcher]:
    """A matcher for each block of items and each gram length in it; one block at a time is on the driver."""
    for block in item_blocks(benchmark, block_bytes):
        letters, _, first, _ = letters_of(pa.array([t for _, t in block]))
        items = [letters[a:b] for a, b in zip(first, first[1:], strict=False)]
        lengths = [gram_length(len(i), edit_rate, q) for i in items]
        for own in sorted(set(lengths)):
            some = [n for n, x in enumerate(lengths) if x == own]
            yield Matcher([block[n][0] for n in some], [items[n] for n in some], edit_rate, own)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.06, q: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: a row for each place of a benchmark item in a document."""
    spark, src = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for matcher in matchers(benchmark, edit_rate, q, block_bytes):
        load = broadcast(spark, matcher)

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            m = load()
            for b in chunks(batches):
                ids, rows = b.column("doc_id").to_pylist(), m.find(b.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], ["doc_id", "item_id", "start", "end", "edits"])

        parts.append(src.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.06, q: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents in which no item occurs, all columns. Nothing is shuffled."""
    out = docs
    for matcher in matchers(benchmark, edit_rate, q, block_bytes):
        load = broadcast(docs.sparkSession, matcher)

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            m = load()
            for b in chunks(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in m.find(b.column("text").cast(pa.string()))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

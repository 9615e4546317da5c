"""Which sets may link: regions around rare shingles, without moving a text.

Blocks of documents send their distinct shingles to buckets (ranges of hashes) and learn how many sets hold each.
Singletons {t} of shingles are the pivots here, rarest first: a set is filed only with those among its first
n - ceil(n s) + 1 shingles that another set holds too, and two linked sets always share one of these. In a cell,
sketches in Hamming space decide: bit b of a sketch is the parity of the set's shingles with hash b, so the distance
of two sketches is never more than the sets' symmetric difference, which for linked sets is at most
(1 - s) / (1 + s) times the sum of their sizes. Only sets within that reach are connected, so a passage that many
documents share joins none of them unless most of their shingles agree.

Equal sets of a block collapse to the least id first. The first rows of a cell are its pivots; rows that they do not
bring into the largest group are compared with the whole cell, until no row outside that group is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.blocks import MESSAGE, bucket_bits, messages, narrow, pack, received
from tessera.llm.memory import settled
from tessera.llm.words import U64, mix

FOUND = "kind int, a long, b long, sig long"
#: Kinds of rows: a document's set size (with a hash of the set); a row equal to a lesser one of its block; two that may link.
INFO, SAME, NEAR = 0, 1, 2
#: Bytes kept of a shingle's hash.
WIDTH = 6
#: Cells of up to this many sets are compared pair by pair.
FEW = 8


def to_bytes(s: np.ndarray) -> bytes:
    """The first 48 bits of sorted hashes."""
    return np.ascontiguousarray((s >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def from_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = raw.reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


def sketch_bits(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """A power of two, at least three times what a set of n shingles may differ by."""
    need = np.maximum(64, 3 * (den - num) * n / num)
    return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


def lone(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Where a run of equal sorted keys begins."""
    out = np.ones(len(first), bool)
    if len(first):
        out[1:] = False
        for c in (first, *rest):
            out[1:] |= c[1:] != c[:-1]
    return out


class Block:
    """The different sets of a block: ``ids``, ``n``, and ``flat[first[i]:first[i + 1]]``."""

    def __init__(self, group: pa.Table):
        ids = group["doc_id"].combine_chunks()
        given = ids.is_valid().to_numpy(zero_copy_only=False)
        n = group["n"].combine_chunks().to_numpy()
        sets = group["set"].combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1] if len(sets) else np.zeros(1, np.int64)
        data = sets.buffers()[2]
        flat = from_bytes(np.frombuffer(data, np.uint8)[at[0] : at[-1]]) if data is not None and at[-1] > at[0] else np.zeros(0, U64)
        at = (at - at[0]) // WIDTH
        ids = ids.fill_null(0).to_numpy()
        self.all_ids, self.all_n, self.null_n = ids[given], n[given], n[~given]
        with np.errstate(over="ignore"):
            sums = [np.diff(np.append(U64(0), np.cumsum(mix(flat ^ U64(c)), dtype=U64))[at]) for c in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
        self.all_sig, self.null_sig = sums[0][given], sums[0][~given]
        rows = np.flatnonzero(given & (n > 0))
        rows = rows[np.lexsort((sums[1][rows], sums[0][rows], n[rows], ids[rows]))]
        rows = rows[lone(ids[rows], n[rows], sums[0][rows], sums[1][rows])]  # an id with several sets keeps them all
        of_id, times = np.unique(ids[rows], return_counts=True)
        several = np.isin(ids[rows], of_id[times > 1])
        order = np.lexsort((ids[rows], several, sums[1][rows], sums[0][rows], n[rows]))
        rows, several = rows[order], several[order]
        head = lone(n[rows], sums[0][rows], sums[1][rows])
        least = rows[head][np.cumsum(head) - 1] if len(rows) else rows
        equal = ~head & ~several
        self.same = np.stack([ids[rows[equal]], ids[least[equal]]]) if len(rows) else np.zeros((2, 0), np.int64)
        rows = np.sort(rows[~equal])
        self.ids, self.n = ids[rows], n[rows]
        size = (at[1:] - at[:-1])[rows]
        self.first = np.append(0, np.cumsum(size))
        self.doc = np.repeat(np.arange(len(rows)), size)
        self.flat = flat[np.arange(self.first[-1]) + np.repeat(at[:-1][rows] - self.first[:-1], size)] if len(rows) else np.zeros(0, U64)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles, cut to 32 bits within their bucket; which each is; how many sets hold each."""
        return np.unique(self.flat >> U64(16 - bits), return_inverse=True, return_counts=True)

    def sketches(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """All sketches, joined, and how many bytes each has."""
        wide = sketch_bits(self.n, num, den)
        begin = np.append(0, np.cumsum(wide))
        place = begin[self.doc] + (mix(self.flat) & (wide[self.doc] - 1).astype(U64)).astype(np.int64)
        return np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little"), wide // 8


def per_bucket(keys: np.ndarray) -> list[tuple[int, slice]]:
    head = np.flatnonzero(lone(keys >> U64(32)))
    if not len(head):
        return []
    return [(int(keys[a] >> U64(32)), slice(a, b)) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(keys)], strict=True)]


class Cells:
    """The sets that met in a bucket, and what connects them."""

    def __init__(self, n: np.ndarray, raw: np.ndarray, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        wide = sketch_bits(n, num, den) // 8
        at = np.append(0, np.cumsum(wide))[:-1]
        self.wide, self.matrix, self.place = wide, {}, {}
        for w in np.unique(wide).tolist():
            rows, words, places = [], [], np.full(len(n), -1)
            up = w
            while up <= 2 * w * den / num:  # wider sketches fold to this width
                own = np.flatnonzero(wide == up)
                part = raw[at[own][:, None] + np.arange(up)[None, :]]
                for half in [up >> i for i in range(1, 40) if up >> i >= w]:
                    part = part[:, :half] ^ part[:, half:]
                rows.append(own)
                words.append(np.ascontiguousarray(part).view(U64).reshape(len(own), w // 8))
                up *= 2
            rows = np.concatenate(rows)
            places[rows] = np.arange(len(rows))
            self.matrix[w], self.place[w] = np.concatenate(words), places
        self.root = list(range(len(n)))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.top(i), self.top(j)
            if i != j:
                self.root[max(i, j)] = min(i, j)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that sizes and sketches let link."""
        fits = self.num * np.maximum(self.n[a], self.n[b]) <= self.den * np.minimum(self.n[a], self.n[b])
        a, b = a[fits], b[fits]
        wide, good = np.minimum(self.wide[a], self.wide[b]), np.zeros(len(a), bool)
        for w in np.unique(wide).tolist():
            own, m, p = np.flatnonzero(wide == w), self.matrix[w], self.place[w]
            step = max(1, (1 << 22) // m.shape[1])
            for c in range(0, len(own), step):
                some = own[c : c + step]
                far = np.bitwise_count(m[p[a[some]]] ^ m[p[b[some]]]).sum(1, dtype=np.int64)
                good[some] = (self.den + self.num) * far <= (self.den - self.num) * (self.n[a[some]] + self.n[b[some]])
        return a[good], b[good]

    def meet(self, key: np.ndarray, who: np.ndarray) -> None:
        """Connects what may link in each cell."""
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        head = np.flatnonzero(lone(key))
        size = np.diff(np.append(head, len(key)))
        pairs = []
        for g in range(2, FEW + 1):
            own = who[head[size == g][:, None] + np.arange(g)[None, :]]
            i, j = np.triu_indices(g, 1)
            pairs.append(np.stack([own[:, i].ravel(), own[:, j].ravel()]))
        pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        both = np.unique(pairs[0].astype(np.int64) * len(self.n) + pairs[1])
        self.link(*self.near(both // len(self.n), both % len(self.n)))
        for a, g in zip(head[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            self.cell(who[a : a + g])

    def cell(self, rows: np.ndarray) -> None:
        done = np.zeros(len(rows), bool)
        step = 8
        while True:
            label, count = np.unique([self.top(i) for i in rows.tolist()], return_inverse=True, return_counts=True)[1:]
            todo = np.flatnonzero(~done & (label != count.argmax())) if done.any() else np.arange(len(rows)) if len(count) > 1 else np.zeros(0, int)
            if not len(todo):
                return
            todo = todo[:step]
            for i in todo.tolist():
                self.link(*self.near(np.full(len(rows), rows[i]), rows))
            done[todo] = True
            step = min(64, 2 * step)

    def edges(self, ids: np.ndarray) -> np.ndarray:
        top = np.array([self.top(i) for i in range(len(ids))], np.int64)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, top, ids)
        pairs = np.stack([ids, least[top]])
        return np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)


def candidates(sets: DataFrame, blocks: int, num: int, den: int) -> DataFrame:
    """Rows of FOUND from ``block, doc_id, n, set``."""
    bits = min(16, bucket_bits(blocks))

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        keys, _, times = Block(group).keys(bits)
        return messages([(b, key[0].as_py(), 1, pack(step=np.diff(keys[s].astype(np.uint32), prepend=np.uint32(0)), times=narrow(times[s]))) for b, s in per_bucket(keys)])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        parts = [np.cumsum(x["step"], dtype=np.uint32) for *_, x in got]
        every, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.concatenate([x["times"] for *_, x in got]), len(every))
        rank = np.where(total > 1, np.minimum(255, 1 + 4 * np.log2(total)), 0).astype(np.uint8)[of]
        ends = np.cumsum([len(p) for p in parts])
        return messages([(b, k, 1, pack(rank=rank[e - len(p) : e])) for (b, k, _, _), p, e in zip(got, parts, ends.tolist(), strict=True)])

    def file(key: tuple, group: pa.Table, answered: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        block, me = Block(group), key[0].as_py()
        rows = [(me % (1 << bits), me, 3, pack(ids=block.all_ids, n=narrow(block.all_n), sig=block.all_sig, none=block.null_n, none_sig=block.null_sig, same=block.same))]
        if len(block.ids):
            keys, of, _ = block.keys(bits)
            rank = np.concatenate([x["rank"] for *_, x in received(answered)])
            assert len(rank) == len(keys), "a reply is missing"
            rank = rank[of]
            order = np.argsort(block.doc * 256 + rank, kind="stable")  # a set's shingles are sorted: ties keep that order everywhere
            reach = block.n + (-num * block.n // den) + 1
            order = order[(np.arange(len(order)) - block.first[block.doc]) < reach[block.doc]]
            order = order[rank[order] > 0]
            order = order[np.argsort(of[order], kind="stable")]
            cell, doc = keys[of[order]], block.doc[order]
            raw, wide = block.sketches(num, den)
            at = np.append(0, np.cumsum(wide))[:-1]
            for b, s in per_bucket(cell):
                own, who = np.unique(doc[s], return_inverse=True)
                w = wide[own]
                take = np.repeat(at[own] - np.append(0, np.cumsum(w))[:-1], w) + np.arange(w.sum())
                rows.append((b, me, 2, pack(keys=np.diff(cell[s].astype(np.uint32), prepend=np.uint32(0)), who=narrow(who), ids=block.ids[own], n=narrow(block.n[own]), raw=raw[take])))
        return messages(rows)

    def connect(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        out: list[pa.Table] = []

        def put(k: int, x: np.ndarray | pa.Array, y: np.ndarray, sig: np.ndarray | None = None) -> None:
            sig = pa.nulls(len(x), pa.int64()) if sig is None else pa.array(np.ascontiguousarray(sig).view(np.int64))
            out.append(pa.table({"kind": pa.array(np.full(len(x), k), pa.int32()), "a": x if isinstance(x, pa.Array) else pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "sig": sig}))

        for _, _, k, x in got:
            if k == 3:
                put(INFO, x["ids"], x["n"].astype(np.int64), x["sig"])
                put(INFO, pa.nulls(len(x["none"]), pa.int64()), x["none"], x["none_sig"])
                put(SAME, *x["same"])
        cells = [x for _, _, k, x in got if k == 2]
        if cells:
            ids = np.concatenate([x["ids"] for x in cells])
            start = np.cumsum([0, *(len(x["ids"]) for x in cells)])
            met = Cells(np.concatenate([x["n"].astype(np.int64) for x in cells]), np.concatenate([x["raw"] for x in cells]), num, den)
            met.meet(np.concatenate([np.cumsum(x["keys"], dtype=np.uint32) for x in cells]), np.concatenate([x["who"].astype(np.int64) + s for x, s in zip(cells, start, strict=False)]))
            put(NEAR, *met.edges(ids))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()))})

    by_block = sets.groupBy("block")
    replies = by_block.applyInArrow(settled(ask), MESSAGE).groupBy("bucket").applyInArrow(settled(answer), MESSAGE)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(settled(file), MESSAGE).groupBy("bucket").applyInArrow(settled(connect), FOUND)

"""N-gram Jaccard join in the metric space of shingle sets, by pivots.

A document is the set of its distinct word shingles; two link where their Jaccard similarity is at least
``num / den``. The Jaccard distance is a metric. The join goes down through regions:

1. ``cells``: pivots that are single shingles, rarest first, and sketches of the sets in Hamming space, which never
   lie further apart than the sets. What these connect is a region. No text moves for it.
2. Regions are joined exactly. Larger ones choose documents as pivots, compute all distances to them, file each
   set with its nearest pivot (a Voronoi cell) and replicate it where d(x, p) <= d(x, own) + 2e, as the triangle
   inequality asks; this recurs until a region is small, and is then joined by matrix products, skipping what is
   connected already. A region that pivots don't divide goes through cells of its own first.
   Regions beyond ``region_docs`` take the same step across tasks: ``join_large``.

Document pivots can't come first: sets of unrelated texts are all about 1 apart, so their windows hold every region.
The ids and tasks of regions are broadcast up to ``broadcast_rows`` of them; beyond, texts are joined by a shuffle.

Shingles are 64-bit hashes (48 bits of them in step 1). Null texts and texts without words have empty sets and link with
nothing. Texts with fewer words than a shingle have the whole sequence as their one shingle. Rows without an id take the
component of an equal set, or none; rows that repeat an id share one component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.blocks import number_of_blocks
from tessera.llm.cells import INFO, NEAR, SAME, candidates, to_bytes
from tessera.llm.components import components
from tessera.llm.memory import settled
from tessera.llm.store import discard, table, written
from tessera.llm.words import U64, chunks, hashes, mix, window_hashes, words_of

EDGE = "a long, b long"


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    w = words_of(texts, lower=True)
    word = hashes(w.vocab)[w.codes] if len(w.codes) else np.zeros(0, U64)
    full = {j: mix(window_hashes(word, j) + U64(j)) for j in range(1, k + 1)}
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        size = min(k, b - a)
        s = np.sort(full[size][a : b - size + 1]) if size else np.zeros(0, U64)
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if size else s)
    return out


def document_sets(docs: DataFrame, k: int, blocks: int) -> DataFrame:
    """``block, doc_id, n, set``: blocks by the id, rows without one by their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            sets = shingles(b.column("text"), k)
            ids = b.column("doc_id")
            key = ids.fill_null(0).to_numpy().view(U64) + np.where(ids.is_valid().to_numpy(zero_copy_only=False), U64(0), np.array([s[0] if len(s) else 0 for s in sets], U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(key) % U64(blocks)).astype(np.int32)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([to_bytes(s) for s in sets], pa.binary())],
                ["block", "doc_id", "n", "set"],
            )

    return docs.mapInArrow(run, "block int, doc_id long, n long, set binary")


class RegionJoin:
    """The exact join of one region's sets; ``root`` ends as the least index of each set's component."""

    LEAF, PIVOTS, CELLS = 256, 8, 1 << 22

    def __init__(self, sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None):
        """``known``: labels of sets; those with the same one are connected already."""
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets])
        self.root = np.arange(len(sets)) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
        self.reach = 2 * (1 - num / den) + 1e-9
        self.divided = 0  # times that pivots divided rows
        self.join(np.arange(len(sets)))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.root[max(a, b)] = min(a, b)

    def join(self, rows: np.ndarray) -> None:
        if len(rows) < 2 or len({self.top(int(i)) for i in rows}) == 1:
            return
        if len(rows) <= self.LEAF:
            return self.product(rows)
        flat, ends = np.concatenate([self.sets[i] for i in rows]), np.append(0, np.cumsum(self.size[rows]))
        pivots = rows[np.linspace(0, len(rows) - 1, self.PIVOTS).astype(int)]
        far = np.empty((len(rows), len(pivots)))
        for c, p in enumerate(pivots):
            shared = np.diff(np.append(0, np.cumsum(np.isin(flat, self.sets[p])))[ends])
            union = self.size[rows] + self.size[p] - shared
            far[:, c] = 1 - shared / union
            for i in rows[self.den * shared >= self.num * union].tolist():
                self.link(int(p), i)
        nearest = far.min(1)
        parts = [rows[far[:, c] <= nearest + self.reach] for c in range(len(pivots)) if (far.argmin(1) == c).any()]
        if sum(map(len, parts)) < 2 * len(rows) and max(map(len, parts)) < 0.8 * len(rows):
            self.divided += 1
            for part in parts:
                self.join(part)
            return
        parts = self.cells(rows)  # pivots don't tell these apart
        if len(parts) != 1 or len(parts[0]) < len(rows):
            for part in parts:
                self.join(part)
        else:
            self.product(rows)

    def cells(self, rows: np.ndarray) -> list[np.ndarray]:
        """The same step with single shingles as pivots, rarest in this region first: a set can meet a linked one only in the
        cells of its first n - ceil(n s) + 1 shingles. What these cells connect, as regions of two sets at least."""
        size = self.size[rows]
        of, times = numbered(np.concatenate([self.sets[i] for i in rows]))
        who = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        shared = times[of] > 1
        alone = np.bincount(who[~shared], minlength=len(rows))  # these come first and open no cell
        of, who = of[shared], who[shared]
        order = np.lexsort((of, times[of], who))
        first = np.append(0, np.cumsum(np.bincount(who, minlength=len(rows))))[:-1]
        reach = size - -(-self.num * size // self.den) + 1
        pick = order[np.arange(len(of)) < (first + reach - alone)[who]]
        pick = pick[np.lexsort((who[pick], of[pick]))]
        cell, doc = of[pick], who[pick]
        head = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(doc) else doc
        label = np.arange(len(rows))
        while True:
            low = np.minimum(label[doc], label[least])
            new = label.copy()
            np.minimum.at(new, label[doc], low)
            np.minimum.at(new, label[least], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        order = np.argsort(label, kind="stable")
        cut = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
        return [rows[part] for part in np.split(order, cut[1:]) if len(part) > 1]

    def product(self, rows: np.ndarray) -> None:
        """All pairs of the region: shared counts are products of 0/1 matrices, rows and columns in pieces of CELLS at most.
        It ends as soon as all rows are connected."""
        of, times = numbered(np.concatenate([self.sets[i] for i in rows]))
        who = np.repeat(np.arange(len(rows), dtype=np.int32), self.size[rows])
        shared = times[of] > 1
        of, who = (np.cumsum(times > 1, dtype=np.int32) - 1)[of[shared]], who[shared]
        order = np.argsort(of, kind="stable")
        of, who = of[order], who[order]
        columns, step = (int(of[-1]) + 1 if len(of) else 0), max(1, self.CELLS // len(rows))
        size = self.size[rows].astype(float)
        label = np.unique([self.top(int(i)) for i in rows], return_inverse=True)[1]
        for r in range(0, len(rows), step):
            if not label.any():
                break
            block = slice(r, min(r + step, len(rows)))
            both = np.zeros((block.stop - r, len(rows)), np.float32)
            for a in range(0, columns, step):
                s = slice(*np.searchsorted(of, [a, a + step]))
                m = np.zeros((len(rows), min(step, columns - a)), np.float32)
                m[who[s], of[s] - a] = 1
                both += m[block] @ m.T
            near = self.den * both.astype(float) >= self.num * (size[block, None] + size - both)
            near[np.arange(len(near)), np.arange(block.start, block.stop)] = True  # shingles that no other set has aren't counted
            for i in range(len(near)):
                met = np.unique(label[near[i]])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        head = np.unique(label, return_index=True, return_inverse=True)
        for i, j in zip(rows.tolist(), rows[head[1][head[2]]].tolist(), strict=True):
            self.link(i, j)


def numbered(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each shingle, in sorted order of the shingles, and how often each number occurs."""
    order = np.argsort(flat, kind="stable")
    run = flat[order]
    number = np.zeros(len(flat), np.int32)
    np.cumsum(run[1:] != run[:-1], out=number[1:])
    of = np.empty(len(flat), np.int32)
    of[order] = number
    return of, np.bincount(number).astype(np.int32)


def sets_of(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Shingles of each text, made in pieces: a text's words take many times its size."""
    sets = []
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // (4 << 20)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
        sets += shingles(texts.slice(a, b - a).combine_chunks(), k)
    return sets


def join_regions(group: pa.Table, k: int, num: int, den: int) -> pa.Table:
    """One edge from each document to the least one of its component, for the regions of one task. ``known``, if there, names
    documents that are connected already."""
    group = group.sort_by([("region", "ascending"), ("doc_id", "ascending")])
    region, ids = group["region"].to_numpy(), group["doc_id"].to_numpy()
    known = group["known"].to_numpy() if "known" in group.column_names else None
    sets = sets_of(group["text"], k)
    del group
    edges = []
    cut = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    for a, b in zip(cut, np.append(cut[1:], len(region)), strict=True):
        j = RegionJoin(sets[a:b], num, den, None if known is None else known[a:b])
        again = np.r_[False, ids[a + 1 : b] == ids[a : b - 1]]
        for i in np.flatnonzero(again).tolist():  # rows of one id are one node
            j.link(i - 1, i)
        edges += [(int(ids[a + i]), int(ids[a + t])) for i in np.flatnonzero(~again).tolist() if (t := j.top(i)) != i]
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


MEASURED = "doc_id long, region long, own long, cells array<long>, linked array<long>"


def measured(group: pa.Table, k: int, num: int, den: int) -> pa.Table:
    """Distances of a block's documents to the pivots of their region: the nearest pivot, the pivots whose cells a linked document can
    have, and the pivots that link."""
    group = group.sort_by([("pivot", "ascending"), ("doc_id", "ascending")])
    pivot, ids = group["pivot"].to_numpy(zero_copy_only=False), group["doc_id"].to_numpy()
    region, sets = group["region"].to_numpy(), sets_of(group["text"], k)
    del group
    of = np.flatnonzero(pivot)
    of = of[np.unique(ids[of], return_index=True)[1]]
    docs = np.flatnonzero(~pivot)
    size = np.array([len(sets[i]) for i in docs], np.int64)
    flat, ends = np.concatenate([sets[i] for i in docs] or [np.zeros(0, U64)]), np.append(0, np.cumsum(size))
    far, links = np.empty((len(docs), len(of))), np.zeros((len(docs), len(of)), bool)
    for c, p in enumerate(of.tolist()):
        shared = np.diff(np.append(0, np.cumsum(np.isin(flat, sets[p])))[ends])
        union = size + len(sets[p]) - shared
        far[:, c], links[:, c] = 1 - shared / union, den * shared >= num * union
    reach = far <= far.min(1, keepdims=True) + 2 * (1 - num / den) + 1e-9 if len(of) else links
    names, arrays = ids[of], pa.list_(pa.int64())
    return pa.table({
        "doc_id": pa.array(ids[docs], pa.int64()), "region": pa.array(region[docs], pa.int64()), "own": pa.array(names[far.argmin(1)] if len(docs) else [], pa.int64()),
        "cells": pa.array([names[r] for r in reach], arrays), "linked": pa.array([names[r] for r in links], arrays),
    })


def join_large(src: DataFrame, large: DataFrame, k: int, num: int, den: int, block_docs: int, pivots: int = 32) -> DataFrame:
    """Edges (a, b) that connect what is linked in large regions (``doc_id, region, parts``); the regions are dealt over tasks.

    Some documents of a region are its pivots. Every document is measured against them, filed with the nearest, and linked to those
    that are near enough. That connects most of a region of near copies, so of two documents that may still have to be
    connected one lies outside the largest component. Such a document goes to all cells in its window,
    d(x, p) <= d(x, own) + 2e, where it meets every document filed there, in blocks of both.
    """
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    slot = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(pivots))
    chosen = large.groupBy("region", slot.alias("slot")).agg(F.min_by(F.struct("doc_id", "parts"), F.xxhash64(F.lit(31), "doc_id")).alias("p")).select("region", "p.*")
    asked = large.withColumn("block", part("parts")).withColumn("pivot", F.lit(False))
    asked = asked.unionByName(chosen.withColumn("block", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("pivot", F.lit(True)))
    texts = src.where("doc_id is not null").hint("merge")
    met = texts.join(asked.drop("parts"), "doc_id").groupBy("region", "block")
    found = written(met.applyInArrow(settled(lambda g: measured(g.drop(["block"]), k, num, den)), MEASURED), "measured")
    first = found.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b"))
    root = components(first)
    known = found.select("doc_id", "region", "own", "cells").join(root.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("known", F.coalesce("root", "doc_id")).drop("root")
    same = known.groupBy("doc_id", "region", "own", "known").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))  # an id may have several texts
    known = written(same, "known")
    main = known.groupBy("region", "known").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    outside = known.join(main, "region").where("known <> main").select("doc_id", "region", "known", F.explode("cells").alias("cell"))
    cells = known.groupBy("region", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / block_docs).cast("int").alias("blocks"))
    cells = cells.join(outside.groupBy("region", "cell").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("sides")), ["region", "cell"])  # cells that nobody visits are done
    at = "doc_id", "region", "cell", "known", "block", "side"
    filed = known.withColumnRenamed("own", "cell").join(cells, ["region", "cell"]).withColumn("block", part("blocks")).withColumn("side", F.explode(F.expr("sequence(0, sides - 1)"))).select(*at)
    visits = outside.join(cells, ["region", "cell"]).withColumn("side", part("sides")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*at)
    both = texts.join(filed.unionByName(visits).distinct(), "doc_id").groupBy("region", "cell", "block", "side")
    second = both.applyInArrow(settled(lambda g: join_regions(g.drop(["cell", "block", "side"]), k, num, den)), EDGE)
    return root.toDF("a", "b").unionByName(second)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, blocks: int | None = None, task_shingles: int = 1_500_000, region_docs: int = 16_384, broadcast_rows: int = 300_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the last is the least id that links reach."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks or number_of_blocks(src)
    found = written(candidates(document_sets(src, k, blocks), blocks, num, den), "found")
    info = found.where(F.col("kind") == INFO).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "sig")
    same = found.where(F.col("kind") == SAME).select("a", "b").distinct()
    edges = components(found.where(F.col("kind") == NEAR).select("a", "b"))
    region = edges.union(edges.select("root", "root").distinct()).toDF("doc_id", "region")
    # sizes of regions, then tasks: many small regions in one, large ones in blocks around pivots
    sized = written(region.join(info.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "regions")
    total = sized.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    tasks = max(1, int((total["n"] or 0) // task_shingles) + 1)
    per = sized.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("all"))
    large = per.where((F.col("docs") > region_docs) | (F.col("all") > 8 * task_shingles)).select("region", F.ceil(F.greatest(F.col("docs") / (region_docs / 2), F.col("all") / (4 * task_shingles))).cast("int").alias("parts"))
    split = not large.isEmpty()
    placed = sized.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)))
    if split:
        placed = placed.join(large, "region", "left_anti")
    placed = placed.select("doc_id", "region", "task")
    placed = F.broadcast(placed) if total["rows"] <= broadcast_rows else placed.hint("merge")
    links = src.where("doc_id is not null").join(placed, "doc_id").groupBy("task").applyInArrow(settled(lambda g: join_regions(g.drop(["task"]), k, num, den)), EDGE)
    if split:
        links = components(links.unionByName(join_large(src, sized.join(large, "region").select("doc_id", "region", "parts"), k, num, den, max(1, region_docs // 2)))).toDF("a", "b")
    root = written(links.toDF("id", "root").distinct(), "roots")
    discard(sized)
    equal = info.where("n > 0 and doc_id is not null").groupBy("n", "sig").agg(F.min("doc_id").alias("equal"))
    none = info.where("doc_id is null").join(equal, ["n", "sig"], "left").select("doc_id", "n", F.col("equal").alias("own"))
    rows = info.where("doc_id is not null").select("doc_id", "n", F.col("doc_id").alias("own")).unionByName(none)
    out = rows.join(same, F.col("own") == F.col("a"), "left").select("doc_id", "n", F.coalesce("b", "own").alias("least")).join(root, F.col("least") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "least").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)

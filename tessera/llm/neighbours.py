"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``sample`` vectors (smallest hash of the id) on the driver; every vector is then
filed in its leaf. A query walks the tree best bin first: a priority queue holds open nodes by the inner
product with their centre, the best is opened, leaves are visited as they come up. How many leaves to visit
is calibrated: for some queries the true neighbours are found by brute force over all rows, and visits widen
until the leaves visited hold ``recall`` of them.

Leaves that follow each other in the tree make a task of at most ``task_rows`` rows; a leaf of more (copies of one
vector, for example) is split by hash of the id, and a query goes to each part. Queries travel in blocks of
``query_rows``, one message for each task that one of them visits, and a task takes at most ``task_queries``. Within a
task each leaf is one matrix product with the queries that visit it, and ``k`` rows leave for each query, whatever
the number of leaves. Of vectors that are equal only the k + 1 least ids can be found, so the others are set aside there. Scores
of the rows that may be among the best are sums in double precision over the dimensions in order; ties go to
the smaller id.

Vectors that are null, zero or hold nulls or non-finite numbers take no part. Vectors of different lengths have no inner
product: each length is searched apart. A query never finds its own id. Rows that repeat an id and its vector count once; if an
id has several vectors, all can be found and the least of them asks. With fewer candidates than ``k``, all of them are
returned. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.blocks import narrow, pack, unpack
from tessera.llm.memory import settled
from tessera.llm.store import broadcast, table

FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    ok = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(ok, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class KMeansTree:
    centres: np.ndarray  # of all nodes; the root is 0
    children: list[list[int]]  # empty: a leaf

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branch: int = 8, rounds: int = 8, seed: int = 5) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centres, children, todo = [x.mean(0)], [[]], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = x[rows]
            if len(rows) <= leaf_rows or len(different := np.unique(own, axis=0)) < 2:
                continue
            c = different[rng.permutation(len(different))[:branch]].copy()
            for _ in range(rounds):
                near = np.argmax(own @ c.T - (c * c).sum(1) / 2, axis=1)
                for j in range(len(c)):
                    if (near == j).any():
                        c[j] = own[near == j].mean(0)
            near = np.argmax(own @ c.T - (c * c).sum(1) / 2, axis=1)
            used = [j for j in range(len(c)) if (near == j).any()]
            if len(used) < 2:
                continue
            for j in used:
                children[node].append(len(centres))
                todo.append((len(centres), rows[near == j]))
                centres.append(c[j])
                children.append([])
        return cls(np.array(centres), children)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each level."""
        at = np.zeros(len(x), np.int64)
        half = (self.centres**2).sum(1) / 2
        for node in range(len(self.children)):  # parents come before their children
            kids = self.children[node]
            rows = np.flatnonzero(at == node) if kids else ()
            if len(rows):
                at[rows] = np.array(kids)[np.argmax(x[rows] @ self.centres[kids].T - half[kids], axis=1)]
        return at

    def walk(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first traversal comes to."""
        value = self.centres @ query
        queue, out = [(-value[0], 0)], []
        while queue and len(out) < visits:
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-value[kid], kid))
            else:
                out.append(node)
        return out

    def leaves(self) -> int:
        return sum(not c for c in self.children)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, visits: list[tuple[np.ndarray, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: query ids, row ids, exact scores. ``visits``: which queries see which rows (all of them, if None)."""
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if visits is None:
        rough = queries @ rows.T
    else:
        rough = np.full((len(queries), len(rows)), -np.inf)
        for who, a, b in visits:
            rough[who, a:b] = queries[who] @ rows[a:b].T
    order = np.argsort(row_ids, kind="stable")
    low, high = np.searchsorted(row_ids[order], query_ids), np.searchsorted(row_ids[order], query_ids, "right")
    for i in np.flatnonzero(high > low).tolist():
        rough[i, order[low[i] : high[i]]] = -np.inf
    cut = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(queries), -np.inf)
    slack = 1e-12 * np.sqrt((queries**2).sum(1)) * np.sqrt((rows**2).sum(1).max())
    i, j = np.nonzero((rough >= (cut - slack)[:, None]) & (rough > -np.inf))
    score = np.zeros(len(i))
    for d in range(rows.shape[1]):  # one order of summation everywhere: equal vectors get equal scores
        score += queries[i, d] * rows[j, d]
    order = np.lexsort((row_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(queries)))
    keep = np.arange(len(i)) - first[i] < k
    return query_ids[i[keep]], row_ids[j[keep]], score[keep]


def findable(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of some query: of equal vectors the k + 1 least ids, each once."""
    same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    new = np.r_[True, (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    order = order[new]
    head = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return np.sort(order[place <= k])


def merged_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries over all rows."""
    load = broadcast(rows.sparkSession, (ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = load()
        for b in batches:
            y, found = matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            own = findable(y, found, k) if len(y) else np.zeros(0, np.int64)
            got = best(q, qi, y[own], found[own], k)
            yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["query_id", "vec_id", "score"])

    return merged_best(rows.mapInArrow(run, FOUND).distinct(), k)


@dataclass
class Plan:
    tree: KMeansTree
    visits: int
    recall: float
    tasks: dict[int, tuple[int, int]]  # leaf -> its first task, and how many tasks hold it


def dealt(tree: KMeansTree, sizes: dict[int, int], task_rows: int) -> dict[int, tuple[int, int]]:
    """Tasks of leaves that follow each other in the tree; a large leaf has several of its own."""
    out, task, room, todo = {}, -1, 0, [0]
    while todo:
        node = todo.pop()
        todo += tree.children[node][::-1]
        if tree.children[node] or not (n := sizes.get(node, 0)):
            continue
        if n > task_rows:
            parts = -(-n // task_rows)
            out[node], task, room = (task + 1, parts), task + parts, 0
            continue
        if n > room:
            task, room = task + 1, task_rows
        out[node], room = (task, 1), room - n
    return out


def plan_search(rows: DataFrame, is_query: Column, k: int, sample: int, leaf_rows: int, task_rows: int, recall: float, probes: int, n: int) -> Plan:
    """Fits the tree and calibrates it; what comes to the driver is bounded by ``sample`` and ``probes``."""
    x = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()["embedding"])
    tree = KMeansTree.fit(x, max(2, leaf_rows * len(x) // n))
    load = broadcast(rows.sparkSession, tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load()
        for b in batches:
            leaf, count = np.unique(t.leaf_of(matrix(b.column("embedding"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(count)], ["leaf", "n"])

    sizes = {r["leaf"]: r["n"] for r in rows.mapInArrow(file, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    asked = rows.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "embedding").limit(probes).toArrow()
    qi, at = np.unique(asked["vec_id"].to_numpy(), return_index=True)
    q = matrix(asked["embedding"])[at] if len(at) else np.zeros((0, x.shape[1]))
    visits, reached = 1, 1.0
    if len(qi):
        true = brute_force(rows, qi, q, k).join(rows, "vec_id").select("query_id", "embedding").toArrow()
        leaf = tree.leaf_of(matrix(true["embedding"]))
        order = {int(i): {leaf: r for r, leaf in enumerate(tree.walk(v, len(tree.children)))} for i, v in zip(qi, q, strict=True)}
        rank = np.sort([order[i][int(f)] for i, f in zip(true["query_id"].to_pylist(), leaf, strict=True)])
        if len(rank):
            visits = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
            reached = float((rank < visits).mean())
    return Plan(tree, visits, reached, dealt(tree, sizes, task_rows))


def search(rows: DataFrame, is_query: Column, k: int = 20, sample: int = 20_000, leaf_rows: int = 512, task_rows: int = 8192, recall: float = 0.95, probes: int = 100, query_rows: int = 512, task_queries: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row that ``is_query`` holds for."""
    rows = usable(rows)
    per = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("asked")).orderBy("d").collect()
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in per:
        own = rows.where(F.size("embedding") == r["d"])
        plan = plan_search(own, is_query, k, sample, leaf_rows, task_rows, recall, probes, r["n"])
        found = visited(own, is_query, plan, k, query_rows, -(-(r["asked"] or 0) // task_queries) or 1)
        out = found if len(per) == 1 else out.unionByName(found)
    return out


def visited(rows: DataFrame, is_query: Column, plan: Plan, k: int, query_rows: int, parts: int) -> DataFrame:
    """The search of vectors of one length. ``parts``: into how many the queries of a task are divided."""
    load = broadcast(rows.sparkSession, plan)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load()
        first, count = (np.zeros(len(p.tree.children), np.int64) for _ in range(2))
        for f, (task, n) in p.tasks.items():
            first[f], count[f] = task, n
        for b in batches:
            leaf, ids = p.tree.leaf_of(matrix(b.column("embedding"))), b.column("vec_id").to_numpy()
            scattered = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            task = first[leaf] + scattered % np.maximum(1, count[leaf])
            for part in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(np.full(len(ids), part, np.int32)), pa.array(leaf), b.column("vec_id"), b.column("embedding")], ["task", "part", "leaf", "vec_id", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load()
        for b in batches:
            every, ids = matrix(b.column("embedding")), b.column("vec_id").to_numpy()
            side = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % parts
            for part in range(parts):
                mine = np.flatnonzero(side == part)
                for a in range(0, len(mine), query_rows):
                    some = mine[a : a + query_rows]
                    to: dict[int, list[tuple[int, int]]] = {}
                    for i, v in enumerate(every[some]):
                        for f in p.tree.walk(v, p.visits):
                            first, n = p.tasks.get(f, (0, 0))
                            for t in range(first, first + n):
                                to.setdefault(t, []).append((i, f))
                    sent = []
                    for t, pairs in to.items():
                        i, f = np.array(pairs).T
                        own, i = np.unique(i, return_inverse=True)
                        sent.append((t, part, pack(ids=ids[some[own]], x=every[some[own]], who=narrow(i), leaf=narrow(f))))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in sent], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["task", "part", "payload"])

    def visit(asked: pa.Table, filed: pa.Table) -> pa.Table:
        x, ids, leaf = matrix(filed["embedding"]), filed["vec_id"].to_numpy(), filed["leaf"].to_numpy()
        own = findable(x, ids, k) if len(ids) else np.zeros(0, np.int64)
        own = own[np.argsort(leaf[own], kind="stable")]
        x, ids, leaf = x[own], ids[own], leaf[own]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for payload in asked["payload"].to_pylist():
            m = unpack(payload)
            of, who = m["leaf"].astype(np.int64), m["who"].astype(np.int64)
            order = np.argsort(of, kind="stable")
            leaves, at = np.unique(of[order], return_index=True)
            visits = [(who[order][a:b], *np.searchsorted(leaf, [f, f + 1]).tolist()) for f, a, b in zip(leaves.tolist(), at.tolist(), [*at[1:].tolist(), len(of)], strict=True)]
            out.append(best(m["x"], m["ids"], x, ids, k, visits))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    filed = rows.mapInArrow(file, "task int, part int, leaf long, vec_id long, embedding array<double>").groupBy("task", "part")
    asked = queries.mapInArrow(ask, "task int, part int, payload binary").groupBy("task", "part")
    out = merged_best(asked.cogroup(filed).applyInArrow(settled(visit), FOUND), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

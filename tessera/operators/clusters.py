"""Partitioned and compressed vector indexes: k-means cells, product codes, and principal components.

Cells and codebooks are fitted on a bounded sample (``sample`` rows, 50,000 by default), principal components on all rows;
every row is assigned and searchable.
How many cells a search probes and how many rows it ranks anew is calibrated: for some rows as queries the true neighbours are
found by brute force over all rows, and the setting is the least that reaches ``RECALL`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.vectors import squared_l2
from tessera.operators.knn import literal

SAMPLE, RECALL, PROBES = 50_000, 0.95, 200


def sampled(vectors: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows, the same ones in each run."""
    return vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("embedding"))


def kmeans(vectors: DataFrame, k: int, iterations: int = 20, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centres as rows; k-means++ in parallel, then Lloyd's iterations."""
    rows = sampled(vectors, sample).select(array_to_vector("embedding").alias("features"))
    return np.array(KMeans(k=k, maxIter=iterations, seed=seed).fit(rows).clusterCenters())


def cells_for(n: int) -> int:
    return max(2, min(256, n // 10))


def nearest_centre(v: Column, centres: np.ndarray) -> Column:
    """The index of the nearest centre; a few hundred centres travel with the function."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        x = np.array(s.tolist(), float)
        return pd.Series(((centres**2).sum(1) - 2 * x @ centres.T).argmin(1).astype("int32")) if len(s) else pd.Series([], dtype="int32")

    return run(v)


def with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows of the model's dimension with their ``cell``; written by ``partitionBy('cell')`` a search reads its cells alone."""
    return vectors.where(F.size("embedding") == centres.shape[1]).withColumn("cell", nearest_centre(F.col("embedding"), centres))


def true_neighbours(rows: DataFrame, keep: str, k: int, probes: int = PROBES) -> tuple[np.ndarray, pd.DataFrame]:
    """Vectors of at most ``probes`` rows as queries, and ``probe, id`` and the column ``keep`` of the k nearest other rows of each."""
    some = rows.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(probes).select("id", "embedding").toPandas()
    own, q = some["id"].to_numpy(), np.array(some["embedding"].tolist(), float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, ids = np.array(b["embedding"].tolist(), float), b["id"].to_numpy()
            for i, v in enumerate(q):
                d = ((x - v) ** 2).sum(1)
                d[ids == own[i]] = np.inf
                at = np.lexsort((ids, d))[:k]
                at = at[d[at] < np.inf]
                yield b.iloc[at][["id", keep]].assign(probe=i, distance=d[at])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.where("embedding is not null").select("id", "embedding", keep).mapInPandas(run, f"id {types['id']}, {keep} {types[keep]}, probe int, distance double")
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("distance", "id"))).where(F.col("r") <= k)
    return q, near.select("probe", "id", keep).toPandas()


def least_reach(ranks: np.ndarray, recall: float) -> tuple[int, float]:
    """The least number of first places that hold ``recall`` of the ranks (from 0), and the part they hold."""
    ranks = np.sort(ranks)
    reach = int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1
    return reach, float((ranks < reach).mean())


def calibrated_nprobe(cells: DataFrame, centres: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> tuple[int, float]:
    """How many cells to probe, and the recall measured with these; all cells where there is nothing to measure."""
    q, true = true_neighbours(cells, "cell", k, probes)
    if not len(true):
        return len(centres), 1.0
    place = np.array([((centres - v) ** 2).sum(1).argsort(kind="stable").argsort() for v in q])
    return least_reach(place[true["probe"], true["cell"]], recall)


def ivf_search(cells: DataFrame, centres: np.ndarray, query: list[float], k: int, nprobe: int | None = None) -> DataFrame:
    """``id, distance`` of the k nearest in the nprobe nearest cells, as calibrated if none are given; exact where nprobe is the number of cells."""
    if nprobe is None:
        nprobe = calibrated_nprobe(cells, centres, k)[0]
    order = ((centres - np.array(query)) ** 2).sum(1).argsort(kind="stable")[:nprobe]
    near = cells.where(F.col("cell").isin(*order.tolist()))
    return near.select("id", squared_l2(F.col("embedding"), literal(query)).alias("distance")).orderBy("distance", "id").limit(k)


class ProductCodes:
    """Codebooks for ``parts`` slices of a vector, up to 256 words each."""

    def __init__(self, vectors: DataFrame, parts: int = 32, words: int = 256, iterations: int = 10, seed: int = 42, sample: int = SAMPLE):
        rows = sampled(vectors, sample).cache()
        dim = len(rows.first()["embedding"])
        if dim % parts:
            raise ValueError(f"{dim} components do not divide into {parts} parts")
        self.width, words = dim // parts, min(words, rows.count())
        self.books = [
            np.array(KMeans(k=words, maxIter=iterations, seed=seed).fit(rows.select(array_to_vector(F.slice("embedding", i * self.width + 1, self.width)).alias("features"))).clusterCenters())
            for i in range(parts)
        ]
        rows.unpersist()

    def codes(self, v: Column) -> Column:
        """``array<int>``: the nearest word of each slice."""
        books, width = self.books, self.width

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            x = np.array(s.tolist(), float).reshape(len(s), -1)
            found = [((b**2).sum(1) - 2 * x[:, i * width : (i + 1) * width] @ b.T).argmin(1) for i, b in enumerate(books)]
            return pd.Series(list(np.stack(found, 1).astype("int32")))

        return run(v)

    def table(self, query: np.ndarray) -> np.ndarray:
        """Squared distances of the query's slices to all words."""
        return np.stack([((b - query[i * self.width : (i + 1) * self.width]) ** 2).sum(1) for i, b in enumerate(self.books)])

    def distance(self, codes: Column, query: list[float]) -> Column:
        """Squared distance of the query to coded vectors, from a table of its distances to all words."""
        table = self.table(np.array(query, float))

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            c = np.array(s.tolist(), int).reshape(len(s), -1)
            return pd.Series(table[np.arange(table.shape[0]), c].sum(1))

        return run(codes)

    def calibrated_depth(self, coded: DataFrame, k: int, recall: float = RECALL, probes: int = PROBES) -> tuple[int, float]:
        """How many rows, best by codes first, to rank by their vectors, and the recall measured with these."""
        q, true = true_neighbours(coded, "codes", k, probes)
        if not len(true):
            return k, 1.0
        tables = [self.table(v) for v in q]
        rough = lambda i, codes: tables[i][np.arange(len(tables[i])), codes].sum(1)
        of = [(np.flatnonzero(true["probe"] == i), i) for i in range(len(q))]
        wanted = [(rows, i, true["id"].to_numpy()[rows], rough(i, np.array(true["codes"].iloc[rows].tolist(), int))) for rows, i in of if len(rows)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ahead = np.zeros(len(true), np.int64)
            for b in batches:
                if not len(b):
                    continue
                codes, ids = np.array(b["codes"].tolist(), int), b["id"].to_numpy()
                for rows, i, own, at in wanted:
                    d = rough(i, codes)
                    for r, o, x in zip(rows, own, at, strict=True):
                        ahead[r] += ((d < x - 1e-9) | ((d <= x + 1e-9) & (ids < o))).sum()
            yield pd.DataFrame({"row": np.arange(len(true)), "ahead": ahead})

        counts = coded.where("codes is not null").select("id", "codes").mapInPandas(run, "row int, ahead long").groupBy("row").agg(F.sum("ahead").alias("ahead"))
        depth, reached = least_reach(counts.toPandas()["ahead"].to_numpy(), recall)
        return max(k, depth), reached

    def search(self, coded: DataFrame, query: list[float], k: int, depth: int | None = None) -> DataFrame:
        """The best ``depth`` by codes (``codes``), as calibrated if none is given, then the k nearest of these by the vectors themselves."""
        depth = self.calibrated_depth(coded, k)[0] if depth is None else depth
        rough = coded.withColumn("rough", self.distance(F.col("codes"), query)).orderBy("rough", "id").limit(depth)
        return rough.select("id", squared_l2(F.col("embedding"), literal(query)).alias("distance")).orderBy("distance", "id").limit(k)


def principal_components(vectors: DataFrame, k: int) -> np.ndarray:
    """Of all rows; rows are components, each one's largest entry is positive."""
    rows = vectors.where("embedding is not null").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    pc = PCA(k=k, inputCol="features", outputCol="p").fit(rows).pc.toArray().T
    return pc * np.sign(pc[np.arange(k), np.abs(pc).argmax(1)])[:, None]


def projected(v: Column, components: np.ndarray) -> Column:
    """Products with the components; vectors are not centred."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(s.tolist(), float).reshape(len(s), -1) @ components.T))

    return run(v)

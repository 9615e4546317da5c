"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Preference pairs join every row labelled 1 with every
row labelled 0; the mean logistic loss on their feature differences is minimised by Newton steps. The threshold is
the quantile of the fitted rows' scores at their share of label 0, and ``score`` is that score on a logistic
scale set so that the threshold lies at ``cut``.

The model is fitted on all labelled training rows and all their pairs, none drawn. A pair's loss depends on two
strengths only, so sums over pairs come from sums over rows: strengths are filed in cells of width ``WIDTH``, and in
a cell the loss of any other strength is a polynomial of degree ``DEGREE - 1`` to about 13 digits (its poles are pi
away). A Newton step is one pass over the rows' stored features; what comes to the driver is a small matrix for each
cell. The threshold comes from histograms that narrow down to the one value. Documents' features, a few numbers each,
are stored once; labels meet them there, not the texts.

Null and empty texts get a score (their features are zeros). Ties score alike. Rows repeat in the result as
in the input. Label rows with a null label or id take no part; where one label is missing altogether the
score is the smoothed share of label 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.memory import settle, settled
from tessera.llm.store import broadcast, discard, table, written
from tessera.llm.words import chunks, utf8, words_of

LETTER, UPPER, DIGIT, POINT, SYMBOL, BAR, SHOUT, LINE = range(8)
NAMES = ["upper", "digit", "point", "symbol", "bar", "shout", "line", "letter", "same_next", "distinct", "top", "word_len", "n_words", "short_tail"]


def byte_classes() -> np.ndarray:
    out = np.zeros((8, 256), bool)
    for b in range(256):
        c = chr(b)
        out[LETTER, b] = b >= 0x80 or c.isalpha()
        out[UPPER, b] = 0x41 <= b <= 0x5A
        out[DIGIT, b] = 0x30 <= b <= 0x39
        out[POINT, b] = c in ".,;:?'\"()-"
        out[SYMBOL, b] = c in "#$%&*+/<=>@[\\]^_`{}~"
        out[BAR, b] = c == "|"
        out[SHOUT, b] = c == "!"
        out[LINE, b] = c == "\n"
    return out


CLASSES = byte_classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text. Shares are square-rooted: a text with a bad half stands out almost like a bad one."""
    raw, at = utf8(texts)
    w = words_of(texts)
    n, words = w.n_docs, w.counts()
    sums = np.zeros((8, n))
    for k in range(8):
        run = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(CLASSES[k][raw], out=run[1:])
        sums[k] = np.diff(run[at])
    solid = np.maximum(sums[[LETTER, DIGIT, POINT, SYMBOL, BAR, SHOUT]].sum(0), 1)
    letters = np.maximum(sums[LETTER], 1)
    some = np.maximum(words, 1)
    doc = w.doc_of_word()
    pair = doc * np.int64(max(1, len(w.vocab))) + w.codes
    same = np.bincount(doc[1:][pair[1:] == pair[:-1]], minlength=n) if len(doc) else np.zeros(n)
    uniq, count = np.unique(pair, return_counts=True)
    of = uniq // max(1, len(w.vocab))
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    distinct = np.bincount(of, minlength=n) if len(of) else np.zeros(n)
    share = np.stack([sums[UPPER] / letters, sums[DIGIT] / solid, sums[POINT] / solid, sums[SYMBOL] / solid, sums[BAR] / solid, sums[SHOUT] / solid, sums[LINE] / some, sums[LETTER] / solid, same / some, distinct / some, top / some])
    size = np.stack([solid / some / 10, np.log1p(words) / 5, 1 / (1 + words / 20)])
    return np.concatenate([np.sqrt(share), size]).T


@dataclass
class PairwiseModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float
    slope: float
    cut: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return strengths(standard(x, self.mean, self.scale), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (self.strength(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x - mean) / scale


def strengths(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Column by column, so that a row's strength does not depend on the rows beside it."""
    out = np.zeros(len(z))
    for k, w in enumerate(weights.tolist()):
        out += z[:, k] * w
    return out


#: Cells of strengths, and how many Chebyshev polynomials stand for a function in one.
WIDTH, DEGREE = 2.0, 16


def cell_sums(z: np.ndarray, s: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell the sums, over the rows whose strengths lie there, of each polynomial times 1, z and the products of z."""
    cell = np.floor(s / WIDTH).astype(np.int64)
    i, j = np.triu_indices(z.shape[1])
    out = {}
    for c in np.unique(cell).tolist():
        here = np.flatnonzero(cell == c)
        rows = z[here]
        shape = np.polynomial.chebyshev.chebvander(2 * (s[here] / WIDTH - c) - 1, DEGREE - 1)
        out[c] = shape.T @ np.concatenate([np.ones((len(rows), 1)), rows, rows[:, i] * rows[:, j]], 1)
    return out


def at_nodes(sums: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same rows as weighted points: a sum over rows of a function of strength is that over these points."""
    nodes = np.cos(np.pi * (np.arange(DEGREE) + 0.5) / DEGREE)
    basis = np.polynomial.chebyshev.chebvander(nodes, DEGREE - 1) * 2 / DEGREE
    basis[:, 0] /= 2
    cells = sorted(sums)
    return np.concatenate([(c + (nodes + 1) / 2) * WIDTH for c in cells]), np.concatenate([basis @ sums[c] for c in cells])


def pair_loss(good: dict[int, np.ndarray], bad: dict[int, np.ndarray], w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs plus the ridge, its gradient and its second derivatives."""
    (t, g), (u, b) = at_nodes(good), at_nodes(bad)
    d, n = len(w), g[:, 0].sum() * b[:, 0].sum()
    loss, grad, cross, square = 0.0, np.zeros(d), np.zeros((d, d)), np.zeros((d, d))
    upper = np.triu_indices(d)
    for k in range(0, len(t), 256):
        gap, part = t[k : k + 256, None] - u, g[k : k + 256]
        lost = 1 / (1 + np.exp(np.clip(gap, -700, 700)))
        bend = lost * (1 - lost)
        loss += part[:, 0] @ np.logaddexp(0, -gap) @ b[:, 0]
        grad += b[:, 1 : d + 1].T @ (part[:, 0] @ lost) - part[:, 1 : d + 1].T @ (lost @ b[:, 0])
        cross += part[:, 1 : d + 1].T @ bend @ b[:, 1 : d + 1]
        square[upper] += part[:, d + 1 :].T @ (bend @ b[:, 0]) + b[:, d + 1 :].T @ (part[:, 0] @ bend)
    square = square + np.triu(square, 1).T
    return loss / n + ridge / 2 * w @ w, grad / n + ridge * w, (square - cross - cross.T) / n + ridge * np.eye(d)


def least_loss(sums: Callable[[np.ndarray], list[dict[int, np.ndarray]]], d: int, ridge: float) -> np.ndarray:
    """The weights of least loss; ``sums(w)`` gives the cells of label 0 and of label 1. Newton steps, halved while the loss doesn't fall."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        bad, good = sums(w)
        return pair_loss(good, bad, w, ridge)

    w = np.zeros(d)
    loss, grad, hess = at(w)
    while True:
        step = np.linalg.solve(hess, grad)
        while True:
            if np.abs(step).max() < 1e-6:
                return w - step
            found = at(w - step)
            if found[0] <= loss - 1e-4 * step @ grad + 1e-12:
                break
            step = step / 2
        w, (loss, grad, hess) = w - step, found


def parting(value: float, after: float, below: float | None, share: float) -> float:
    """The threshold: from the quantile, which lies between two neighbours in order, midway to the next lower score."""
    at = value + (after - value) * (1 - share)
    lower = value if at > value else below
    return at if lower is None else (at + lower) / 2


def one_label(n: int, good: int, d: int, cut: float) -> PairwiseModel:
    one = np.ones(d)
    return PairwiseModel(one, one * 0, one, 0.0, 1.0, cut, float((good + 1) / (n + 2)))


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, cut: float = 0.3) -> PairwiseModel:
    """The model of rows that are at hand."""
    bad, n = int((y == 0).sum()), len(y)
    if bad in (0, n):
        return one_label(n, n - bad, x.shape[1] if x.ndim == 2 else 1, cut)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = standard(x, mean, scale)

    def sums(w: np.ndarray) -> list[dict[int, np.ndarray]]:
        s = strengths(z, w)
        return [cell_sums(z[y == k], s[y == k]) for k in (0, 1)]

    w = least_loss(sums, x.shape[1], ridge)
    s = np.sort(strengths(z, w))
    below = s[s < s[bad - 1]]
    threshold = parting(float(s[bad - 1]), float(s[bad]), float(below[-1]) if len(below) else None, bad / n)
    return PairwiseModel(w, mean, scale, threshold, float(4 / max(s.std(), 1e-9)), cut)


def sure_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """``doc_id, label`` of each training id whose labels agree."""
    rows = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = rows.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("__most")).where("label = __most")
    return one.drop("__most")


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, by hash of the id: a seeded sample of known size."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def arrays(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def numbers(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows, few at once, so that temporary arrays stay small; freed memory is given back after each batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        settle()


def quality_features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), arrays(features(b.column("text")))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def nth_smallest(values: DataFrame, n: int, bins: int = 4096) -> float:
    """The n-th smallest value of ``s``, from 1: the bin that holds it, then that bin's bins, until one value is left."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        for b in sorted(values.where(F.col("s").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if n <= b["n"]:
                break
            n -= b["n"]
        low, high = b["low"], b["high"]
    return low


CELLS = "part int, label int, cell long, sums array<double>"


def fit_rows(rows: DataFrame, width: int, ridge: float = 1e-3, cut: float = 0.3) -> PairwiseModel:
    """The model of ``fit_pairs`` for rows ``label, x`` of any number. They are read several times, so should be stored."""
    x = [F.col("x")[k] for k in range(width)]
    told = rows.agg(F.count("*"), F.sum("label"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n, good = told[0], told[1] or 0
    if good in (0, n):
        return one_label(n, good, width, cut)
    mean, scale = np.array(told[2 : width + 2]), np.array(told[width + 2 :]) + 1e-9

    def sums(w: np.ndarray) -> list[dict[int, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in slices(batches):
                z, y = standard(numbers(b.column("x"), width), mean, scale), b.column("label").to_numpy()
                for k in (0, 1):
                    mine = z[y == k]
                    for c, v in cell_sums(mine, strengths(mine, w)).items():
                        total[k, c] = total[k, c] + v if (k, c) in total else v
            part = TaskContext.get().partitionId()
            for (k, c), v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([c], pa.int64()), arrays(v.reshape(1, -1))], ["part", "label", "cell", "sums"])

        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("part")  # in one order, so that every run gives the same sum
            v = numbers(group["sums"].combine_chunks(), len(group["sums"][0])).sum(0)
            return group.slice(0, 1).set_column(3, "sums", arrays(v.reshape(1, -1)))

        out: list[dict[int, np.ndarray]] = [{}, {}]
        for r in rows.mapInArrow(run, CELLS).groupBy("label", "cell").applyInArrow(settled(add), CELLS).toArrow().to_batches():
            for k, c, v in zip(r["label"].to_pylist(), r["cell"].to_pylist(), r["sums"], strict=True):
                out[k][c] = v.values.to_numpy().reshape(DEGREE, -1)
        return out

    w = least_loss(sums, width, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(strengths(standard(numbers(b.column("x"), width), mean, scale), w))], ["s"])

    scores = written(rows.mapInArrow(run, "s double"), "strengths")
    value, s = nth_smallest(scores, n - good), F.col("s")
    seen = scores.agg(F.count_if(s <= value).alias("upto"), F.min(F.when(s > value, s)).alias("above"), F.max(F.when(s < value, s)).alias("below"), F.stddev_pop("s").alias("std")).first()
    discard(scores)
    after = value if seen["upto"] > n - good else seen["above"]
    return PairwiseModel(w, mean, scale, parting(value, after, seen["below"], (n - good) / n), float(4 / max(seen["std"], 1e-9)), cut)


def fit_features(found: DataFrame, labels: DataFrame, train: Column) -> PairwiseModel:
    """The model of all rows of ``quality_features`` that have a training label."""
    known = sure_labels(labels, "quality", train)
    rows = written(found.where(train).hint("merge").join(known, "doc_id").select("label", "x"), "labelled")
    model = fit_rows(rows, len(NAMES))
    discard(rows)
    return model


def score_features(found: DataFrame, model: PairwiseModel) -> DataFrame:
    load = broadcast(found.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = load()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.score(numbers(b.column("x"), len(NAMES))), pa.float64())], ["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """``doc_id, score`` of every row."""
    load = broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = load()
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.score(features(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The rows whose score reaches the threshold, all columns. Nothing is shuffled."""
    load = broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = load()
        for b in chunks(batches):
            yield b.filter(pa.array(ranker.score(features(b.column("text"))) >= ranker.cut))

    return docs.mapInArrow(run, docs.schema)


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def held(n: int, rest: int) -> Column:
    """If an id is held out; rows without one have no label to learn from, and are."""
    return F.coalesce(crc_mod(n) == rest, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame) -> PairwiseModel:
    train = crc_mod(5) != 0
    found = written(quality_features(docs.where(train)), "features")
    model = fit_features(found, labels, train)
    discard(found)
    return model


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(quality_features(table(spark, sf_dir, "documents")), "features")
    model = fit_features(found, table(spark, sf_dir, "labels"), crc_mod(5) != 0)
    out = score_features(found, model)
    return out.select("doc_id", held(5, 0).alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))

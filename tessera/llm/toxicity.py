"""Toxicity: a linear-chain conditional random field tags toxic spans.

Token labels come from document labels: a word that occurs in a good share of the toxic documents and next
to never in the others is T in toxic documents, everything else is O. A two-label CRF (word, prefix, suffix
and transition weights) is trained on those chains; forward-backward gives each word's marginal, marginals
are aggregated to a document score by a calibrated logistic of their maximum and sum, and words with a
marginal of at least one half are joined to spans of UTF-8 byte offsets.

A chain is a sentence (it ends at ``. ! ?`` or a new line) of any length; training alone cuts longer ones at
``FIT_CHAIN`` words.

Fitted on at most ``max_rows`` labelled rows of each label, the ones with the smallest hash of their id; an id with
different labels has none. Null and empty texts score as texts without a toxic word. Rows without an id are scored and count
as held out. Ties, repeated rows and extra columns have no effect. Without rows of both labels the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.quality import crc_mod, first_rows, held, sure_labels
from tessera.llm.store import broadcast, table
from tessera.llm.words import Words, chunks, utf8, words_of

FIT_CHAIN, SLOTS, FEATURES = 64, 1 << 16, 4
EDGE = b".,;:!?\"'()[]*#$%&-"


def core(word: bytes) -> bytes:
    return word.lower().strip(EDGE)


def feature_slots(vocab: list[bytes]) -> np.ndarray:
    """Hashed features of each distinct word: itself, its first four and five bytes, its last three bytes."""
    h = xxhash.xxh32_intdigest
    out = np.empty((len(vocab), FEATURES), np.int64)
    for i, word in enumerate(vocab):
        c = core(word)
        out[i] = h(c, 1) % SLOTS, SLOTS + h(c[:4], 2) % SLOTS, 2 * SLOTS + h(c[:5], 4) % SLOTS, 3 * SLOTS + h(c[-3:], 3) % SLOTS
    return out


def chain_starts(w: Words, raw: np.ndarray, most: int | None = None) -> np.ndarray:
    """True where a chain begins. ``most``: words after which a chain is cut, for training."""
    n = len(w.codes)
    out = np.zeros(n, bool)
    if not n:
        return out
    stop = np.array([v[-1:] in (b".", b"!", b"?") for v in w.vocab])[w.codes]
    out[w.first[:-1][w.counts() > 0]] = True
    lines = np.append(0, np.cumsum(raw == 10))
    out[1:] |= stop[:-1] | (lines[w.start[1:]] > lines[w.end[:-1]])
    if most is None:
        return out
    index = np.arange(n)
    since = index - np.maximum.accumulate(np.where(out, index, 0))
    return out | (since % most == 0)


def marginals(emit: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once, a position at a time.

    emit: log-odds of T for each word; moves: 2 x 2 log weights. Returns P(T) of each word, the expected
    number of each transition, and the sum of log Z.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    at = np.flatnonzero(starts)
    size = np.diff(np.append(at, n))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # chains with more than t words
    x = np.exp(np.clip(emit, -30, 30))
    m = np.exp(moves)
    fwd, back, norm = np.empty((n, 2)), np.empty((n, 2)), np.empty(n)
    for t in range(longest):
        i = at[: live[t]] + t
        if t:
            p = fwd[i - 1]
            a0, a1 = p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0], (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * x[i]
        else:
            a0, a1 = np.ones(len(i)), x[i]
        s = a0 + a1
        norm[i] = s
        fwd[i, 0], fwd[i, 1] = a0 / s, a1 / s
    moved = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        i = at[: live[t]] + t
        back[i] = 1
        if t + 1 < longest and (k := live[t + 1]):
            j = i[:k]
            nxt = back[j + 1]
            b0, b1 = nxt[:, 0] / norm[j + 1], nxt[:, 1] * x[j + 1] / norm[j + 1]
            for a in (0, 1):
                back[j, a] = m[a, 0] * b0 + m[a, 1] * b1
                moved[a, 0] += (fwd[j, a] * m[a, 0] * b0).sum()
                moved[a, 1] += (fwd[j, a] * m[a, 1] * b1).sum()
    both = fwd * back
    return both[:, 1] / both.sum(1), moved, float(np.log(norm).sum())


@dataclass
class Crf:
    weights: np.ndarray  # of FEATURES * SLOTS features and a bias
    moves: np.ndarray
    calibration: np.ndarray  # of 1, max marginal, log(1 + sum of marginals)
    constant: float | None = None

    def tag(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        w = words_of(texts)
        raw, _ = utf8(texts)
        emit = (self.weights[feature_slots(w.vocab)].sum(1) + self.weights[-1])[w.codes] if w.vocab else np.zeros(0)
        return w, marginals(emit, chain_starts(w, raw), self.moves)[0]

    def score(self, w: Words, p: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(w.n_docs, self.constant)
        z = np.clip(document_features(w, p) @ self.calibration, -40, 40)
        return 1 / (1 + np.exp(-z))


def document_features(w: Words, p: np.ndarray) -> np.ndarray:
    doc = w.doc_of_word()
    top = np.zeros(w.n_docs)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(w.n_docs), top, np.log1p(np.bincount(doc, np.where(p > 0.01, p, 0), w.n_docs))], 1)


def fit_crf(texts: list[str | None], labels: np.ndarray, base_rate: float, steps: int = 60, share: float = 0.02, seed: int = 3) -> Crf:
    """texts: the sample; base_rate: the share of label 1 among all labelled rows."""
    none = Crf(np.zeros(FEATURES * SLOTS + 1), np.zeros((2, 2)), np.zeros(3))
    if len(set(labels.tolist())) < 2:
        none.constant = float((labels.sum() + 1) / (len(labels) + 2))
        return none
    array = pa.array(texts, pa.string())
    w, (raw, _) = words_of(array), utf8(array)
    # documents that hold each word, by label
    cores: dict[bytes, int] = {}
    core_of = np.fromiter((cores.setdefault(core(v), len(cores)) for v in w.vocab), np.int64, len(w.vocab))
    doc, word = w.doc_of_word(), core_of[w.codes]
    seen = np.unique(word * w.n_docs + doc)
    held = np.bincount(seen // w.n_docs, minlength=len(cores)), np.bincount(seen // w.n_docs, labels[seen % w.n_docs], len(cores))
    toxic, clean = held[1], held[0] - held[1]
    n1, n0 = labels.sum(), (1 - labels).sum()
    lift = ((toxic + 0.5) / (n1 + 1)) / ((clean + 0.5) / (n0 + 1))
    bad = (toxic >= max(3, share * n1)) & (lift >= 10)
    bad[cores.get(b"", 0)] &= b"" not in cores
    y = (bad[word] & (labels[doc] == 1)).astype(float)
    # chains with a toxic word, and others as many times four
    starts = chain_starts(w, raw, FIT_CHAIN)
    chain = np.cumsum(starts) - 1
    hot = np.bincount(chain, y, chain[-1] + 1 if len(chain) else 0) > 0
    rng = np.random.default_rng(seed)
    pick = hot | (rng.random(len(hot)) < min(1.0, (4 * hot.sum() + 5000) / max(1, len(hot))))
    keep = pick[chain]
    slots, starts, y = feature_slots(w.vocab)[w.codes[keep]], starts[keep], y[keep]
    none.weights[-1] = -3
    first, second = [np.zeros(len(none.weights) + 4) for _ in range(2)]
    same = ~starts[1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    flat, total = slots.ravel(), max(1, len(y))
    for step in range(1, steps + 1):  # Adam on the exact gradient: observed minus expected counts
        p, moved, _ = marginals(none.weights[slots].sum(1) + none.weights[-1], starts, none.moves)
        err = p - y
        grad = np.concatenate([np.bincount(flat, np.repeat(err, FEATURES), len(none.weights)), (moved - observed).ravel()])
        grad[len(none.weights) - 1] = err.sum()
        grad = grad / total * 1000 + 1e-3 * np.concatenate([none.weights, none.moves.ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        none.weights -= move[:-4]
        none.moves -= move[-4:].reshape(2, 2)
    w, p = none.tag(array)
    x, c = document_features(w, p), np.zeros(3)
    for _ in range(50):  # logistic regression; the ridge keeps separable labels finite
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (q - labels) + 0.05 * c)
    c[0] += np.log(base_rate / (1 - base_rate)) - np.log(n1 / n0)
    none.calibration = c
    return none


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 1500) -> Crf:
    train = crc_mod(4) != 2
    known = sure_labels(labels, "toxic", train)
    all_rows = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = first_rows(known.where("label = 1"), max_rows).union(first_rows(known.where("label = 0"), max_rows))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").toPandas().sort_values("doc_id").drop_duplicates("text")
    n = sum(all_rows.values())
    return fit_crf(rows["text"].tolist(), rows["label"].to_numpy(float), min(max(all_rows.get(1, 0) / n, 1e-3), 1 - 1e-3) if n else 0.5)


def score_toxicity(docs: DataFrame, model: Crf, spans: bool = True) -> DataFrame:
    """``doc_id, score, spans``: spans are [start, end) UTF-8 byte offsets of runs of offending words."""
    load = broadcast(docs.sparkSession, model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = load()
        for b in chunks(batches):
            w, p = crf.tag(b.column("text"))
            found: list[list[dict]] = [[] for _ in range(w.n_docs)]
            doc_of = np.searchsorted(w.first, at := np.flatnonzero(p >= 0.5), "right") - 1
            last = None
            for i, d in zip(at.tolist(), doc_of.tolist(), strict=True):
                base = int(w.text_at[d])
                if last == (i - 1, d):
                    found[d][-1]["end"] = int(w.end[i]) - base
                else:
                    found[d].append({"start": int(w.start[i]) - base, "end": int(w.end[i]) - base})
                last = (i, d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(crf.score(w, p), pa.float64()), pa.array(found, pa.list_(span))], ["doc_id", "score", "spans"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return out if spans else out.drop("spans")


def op2_toxicity(spark: SparkSession, sf_dir: str, max_rows: int = 1500, cut: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), max_rows)
    out = score_toxicity(docs, model)
    return out.select("doc_id", held(4, 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")

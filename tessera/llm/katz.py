"""Language-model scoring: Katz backoff over bigrams.

Counts of n-grams are discounted by Good-Turing for r <= 5 (Katz's form); the mass that this frees at a context
goes to the next shorter n-gram through a backoff weight that makes the distribution sum to exactly one:

    P(w | h) = d(c) c(h, w) / c(h)   if c(h, w) > 0,   else   a(h) P(w)
    a(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over the same w)

P(w) is the discounted unigram; its freed mass belongs to the unknown word, one class for all words that
training has not seen. A context that training has not seen backs off with weight 1. Counts of counts are smoothed
by a line through their logarithms first, as in simple Good-Turing, since raw ones of real texts are not monotonous. A context
whose counts all exceed 5 frees no mass; its total is raised by one, which frees one count's share.

The tables are partitioned: words by hash, bigrams by their first word. A block of documents asks each bucket for
its own distinct words, then for its own distinct bigrams (with the unigram counts of their second words, so
that a bucket can normalise its contexts by itself), and scores its documents from the replies.

Null and empty texts are scored as the end alone. Rows without an id are held out. Repeated rows count each.
Extra columns are ignored. Without training documents every token is the unknown word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.llm.blocks import MESSAGE, bucket_bits, in_blocks, messages, number_of_blocks, pack, narrow, received, slices
from tessera.llm.memory import settled
from tessera.llm.store import table
from tessera.llm.words import hashes, mix, words_of

END, START = np.uint64(0xE7D5C3B1A9887766), np.uint64(0x1122334455667789)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Counts up to KATZ are discounted; counts of counts up to TOP draw the line.
KATZ, TOP = 5, 16
KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def smoothed(counts_of_counts: list[int]) -> np.ndarray | None:
    """Counts of counts for r = 1 .. KATZ + 1 from a line through log Z(r) over log r, as in simple Good-Turing: Z spreads each count of
    counts over the gap between its neighbours. None without a falling line."""
    n = np.array(counts_of_counts, float)
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return None
    before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    x, y = np.log(r), np.log(n[r - 1] / (0.5 * (after - before)))
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    if slope >= -1:  # no discount below 1 would follow
        return None
    return np.exp(y.mean() + slope * (np.log(np.arange(1, KATZ + 2)) - x.mean()))


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r = 0 .. KATZ + 1 (1 beyond KATZ), from the numbers of n-grams seen 1 .. TOP times: Katz's form of Good-Turing over
    smoothed counts of counts. One d(r) that isn't between 0 and 1 gives way to (r - 1/2) / r, and so do all where a corpus is
    so small that no line can be drawn."""
    d = np.ones(KATZ + 2)
    r = np.arange(1, KATZ + 1)
    n = smoothed(counts_of_counts)
    found = np.full(KATZ, np.nan)
    if n is not None:
        tail = (KATZ + 1) * n[KATZ] / n[0]
        found = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
    d[1 : KATZ + 1] = np.where((found > 0) & (found < 1), found, (r - 0.5) / r)
    d[0] = 0
    return d


class Unigrams:
    """P(w) as a function of w's count; ``stats``: tokens, words and counts of counts of training."""

    def __init__(self, stats: dict):
        self.n, self.v = int(stats["n"]), int(stats["v"])
        self.d = discounts(stats["r"])
        seen = self.n - sum((1 - self.d[r]) * r * c for r, c in enumerate(stats["r"][:KATZ], 1))
        self.total = self.n + (self.n - seen < 1e-9 * self.n)  # no mass freed: one token more makes room for the unknown word
        self.unknown = 1 - seen / self.total if self.n else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, KATZ + 1)] * count / max(1, self.total), self.unknown)


def histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, TOP + 1), minlength=TOP + 2)[1 : TOP + 1]


class Tokens:
    """The tokens of a block: lower-cased words and an end for each text. ``word[-2]`` is the end, ``word[-1]`` the start."""

    def __init__(self, group: pa.Table):
        self.ids = group["doc_id"].to_pylist()
        self.out = held_out(self.ids)
        w = words_of(group["text"], lower=True)
        n, m = w.n_docs, len(w.vocab)
        h = np.concatenate([hashes(w.vocab), [END, START]]).astype(np.uint64)
        order = np.argsort(h)
        rank = np.empty(m + 2, np.int64)
        rank[order] = np.arange(m + 2)
        self.word = h[order]  # sorted
        self.end, self.start = int(rank[m]), int(rank[m + 1])
        self.size = w.counts() + 1
        self.first = np.append(0, np.cumsum(self.size))
        self.token = np.empty(self.first[-1], np.int32)
        ends = self.first[1:] - 1
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = rank[w.codes]
        self.token[ends] = self.end
        self.train = np.repeat(~self.out, self.size)
        self.count = np.bincount(self.token[self.train], minlength=m + 2)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams, sorted: first and second word, count in training here; and the bigram of each token."""
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = self.start
        key, of = np.unique(before.astype(np.int64) * len(self.word) + self.token, return_inverse=True)
        return key // len(self.word), key % len(self.word), np.bincount(of[self.train], minlength=len(key)), of


def score_documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """A row for every row of ``docs``, see RESULT. Training leaves out ids with crc32 mod 7 = 2."""
    blocks = blocks or number_of_blocks(docs)
    bits = bucket_bits(blocks)
    dealt = in_blocks(docs, blocks)
    fields = StructType.fromDDL(RESULT)

    def send_words(key: tuple, group: pa.Table) -> pa.Table:
        t = Tokens(group)
        return messages([(b, key[0].as_py(), 1, pack(keys=t.word[s], count=narrow(t.count[s]))) for b, s in slices(t.word, bits)])

    def meet_words(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        every, of = np.unique(np.concatenate([x["keys"] for *_, x in got]), return_inverse=True)
        total = np.bincount(of, np.concatenate([x["count"] for *_, x in got]), len(every)).astype(np.int64)
        out, a = [], 0
        for b, k, _, x in got:
            own = of[a : a + len(x["keys"])]
            # a word's number is unique: its place in the bucket, then the bucket
            out.append((b, k, 1, pack(count=narrow(total[own]), number=own.astype(np.uint64) << np.uint64(bits) | np.uint64(b))))
            a += len(own)
        return messages(out)

    def word_stats(key: tuple, group: pa.Table) -> pa.Table:
        got = received(group)
        _, of = np.unique(np.concatenate([x["keys"] for *_, x in got]), return_inverse=True)
        total = np.bincount(of, np.concatenate([x["count"] for *_, x in got])).astype(np.int64)
        return pa.table({"n": [int(total.sum())], "v": [int((total > 0).sum())], "r": [histogram(total).tolist()]})

    def send_pairs(key: tuple, group: pa.Table, answered: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        t = Tokens(group)
        count, number = words_answered(received(answered), len(t.word))
        first, second, n, _ = t.pairs()
        out = []
        contexts, at, times = np.unique(first, return_index=True, return_counts=True)
        names = mix(t.word[contexts])  # scattered anew: a bucket of words isn't the bucket of contexts
        order = np.argsort(names)
        for b, s in slices(names[order], bits):
            pick = order[s]
            rows = np.concatenate([np.arange(at[i], at[i] + times[i]) for i in pick])
            out.append((b, key[0].as_py(), 2, pack(context=names[pick], times=narrow(times[pick]), second=narrow(number[second[rows]]), n=narrow(n[rows]), count=narrow(count[second[rows]]))))
        return messages(out)

    def bigrams(got: list) -> tuple[np.ndarray, ...]:
        """Of a bucket: contexts, each row's bigram, and each bigram's context, count and unigram count."""
        contexts, of = np.unique(np.concatenate([x["context"] for *_, x in got]), return_inverse=True)
        of = np.repeat(of, np.concatenate([x["times"] for *_, x in got]).astype(np.int64))
        second = np.concatenate([x["second"].astype(np.uint64) for *_, x in got])
        order = np.lexsort((second, of))
        new = np.r_[True, (of[order][1:] != of[order][:-1]) | (second[order][1:] != second[order][:-1])]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        total = np.bincount(pair, np.concatenate([x["n"].astype(np.int64) for *_, x in got])).astype(np.int64)
        head = order[new]
        return contexts, pair, of[head], total, np.concatenate([x["count"].astype(np.int64) for *_, x in got])[head]

    def pair_stats(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"n": [0], "v": [0], "r": [histogram(bigrams(received(group))[3]).tolist()]})

    def meet_pairs(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return messages([])
        got = received(group)
        of_words, of_pairs = stats_told(received(told))
        uni, d = Unigrams(of_words), discounts(of_pairs["r"])
        contexts, pair, context, total, count = bigrams(got)
        seen = total > 0
        all_ = np.bincount(context, total, len(contexts))
        kept = np.bincount(context[seen], (d[np.minimum(total, KATZ + 1)] * total)[seen], len(contexts))
        all_ += (all_ > 0) & (all_ - kept < 1e-9 * all_)
        taken = np.bincount(context[seen], uni.p(count)[seen], len(contexts))
        with np.errstate(all="ignore"):
            weight = np.where(all_ > 0, (1 - kept / all_) / np.maximum(1 - taken, 1e-300), 1.0)
        out, a, c = [], 0, 0
        place = np.searchsorted(contexts, np.concatenate([x["context"] for *_, x in got]))
        for b, k, _, x in got:
            rows, own = pair[a : a + len(x["n"])], place[c : c + len(x["context"])]
            out.append((b, k, 2, pack(total=narrow(total[rows]), all=narrow(all_[own].astype(np.int64)), weight=weight[own])))
            a, c = a + len(rows), c + len(own)
        return messages(out)

    def score(key: tuple, group: pa.Table, answered: pa.Table) -> pa.Table:
        if not group.num_rows:  # a block without documents is told the sums too
            return pa.table({f.name: pa.array([], KINDS[f.dataType.simpleString()]) for f in fields})
        t, got = Tokens(group), received(answered)
        of_words, of_pairs = stats_told(got)
        uni, d = Unigrams(of_words), discounts(of_pairs["r"])
        count, _ = words_answered(got, len(t.word))
        first, second, _, of = t.pairs()
        contexts, at, times = np.unique(first, return_index=True, return_counts=True)
        order = np.argsort(mix(t.word[contexts]))
        rows = np.concatenate([np.arange(at[i], at[i] + times[i]) for i in order])
        total, all_, weight = np.zeros(len(first), np.int64), np.zeros(len(contexts), np.int64), np.ones(len(contexts))
        mine = [x for _, _, k, x in got if k == 2]
        total[rows] = np.concatenate([x["total"].astype(np.int64) for x in mine])
        all_[order] = np.concatenate([x["all"].astype(np.int64) for x in mine])
        weight[order] = np.concatenate([x["weight"] for x in mine])
        context = np.repeat(np.arange(len(contexts)), times)
        with np.errstate(all="ignore"):
            p = np.where(total > 0, d[np.minimum(total, KATZ + 1)] * total / all_[context], weight[context] * uni.p(count[second]))
        logp = np.log10(np.maximum(p, 1e-300))[of]
        base = np.log10((count + 1) / (uni.n + uni.v + 1))[t.token]
        sums = lambda x: np.add.reduceat(x, t.first[:-1])
        return pa.table({
            "doc_id": pa.array(t.ids, pa.int64()), "held_out": pa.array(t.out), "n_tokens": pa.array(t.size, pa.int64()),
            "n_known": pa.array(sums((count > 0).astype(np.int64)[t.token]), pa.int64()), "train_tokens": pa.array(np.full(len(t.ids), uni.n), pa.int64()),
            "base_score": pa.array(sums(base)), "score": pa.array(sums(logp)),
        })

    def to_all(stats: DataFrame, kind: int, column: str, n: int) -> DataFrame:
        """The sums of a few numbers as a message to each block or bucket."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        one = stats.agg(total("n").alias("n"), total("v").alias("v"), *[total(F.col("r")[i]).alias(f"r{i}") for i in range(TOP)])
        text = F.to_json(F.struct("n", "v", F.array(*[f"r{i}" for i in range(TOP)]).alias("r"))).cast("binary")
        other = "block" if column == "bucket" else "bucket"
        sent = one.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column), F.lit(0).alias(other), F.lit(kind).alias("kind"), text.alias("payload"))
        return sent.select("bucket", "block", "kind", "payload")

    stat = "n long, v long, r array<long>"
    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(settled(send_words), MESSAGE)
    words = asked.groupBy("bucket").applyInArrow(settled(meet_words), MESSAGE)
    of_words = asked.groupBy("bucket").applyInArrow(settled(word_stats), stat)
    pairs = by_block.cogroup(words.groupBy("block")).applyInArrow(settled(send_pairs), MESSAGE)
    of_pairs = pairs.groupBy("bucket").applyInArrow(settled(pair_stats), stat)
    told = to_all(of_words, 11, "bucket", 1 << bits).unionByName(to_all(of_pairs, 12, "bucket", 1 << bits))
    weighed = pairs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(settled(meet_pairs), MESSAGE)
    answers = words.unionByName(weighed).unionByName(to_all(of_words, 11, "block", blocks)).unionByName(to_all(of_pairs, 12, "block", blocks))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(settled(score), RESULT)


def words_answered(got: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    mine = [x for _, _, k, x in got if k == 1]
    count, number = np.concatenate([x["count"].astype(np.int64) for x in mine]), np.concatenate([x["number"] for x in mine])
    assert len(count) == size, "a reply is missing"
    return count, number


def stats_told(got: list) -> tuple[dict, dict]:
    by = {k: x for _, _, k, x in got if k in (11, 12)}
    return by[11], by[12]


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.katz import KATZ, TOP, discounts, op8_lm_scoring, score_documents

D = "/root/testdata/"


def tokens_of(text):
    return [*(text or "").encode().lower().split(), "END"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """Katz over bigrams, from its definition, with dictionaries."""

    def __init__(self, docs):
        self.uni, self.bi = Counter(), Counter()
        for i, t in docs:
            if not held(i):
                own = tokens_of(t)
                self.uni.update(own)
                self.bi.update(zip(["START", *own], own, strict=False))
        ladder = lambda c: [sum(1 for n in c.values() if n == r) for r in range(1, TOP + 1)]
        self.d1, self.d2 = discounts(ladder(self.uni)), discounts(ladder(self.bi))
        self.n = sum(self.uni.values())
        kept = sum(self.d1[min(c, KATZ + 1)] * c for c in self.uni.values())
        self.total = self.n + (self.n - kept < 1e-9 * self.n)
        self.unknown = 1 - kept / self.total if self.n else 1.0
        self.after = {}
        for (h, w), c in self.bi.items():
            self.after.setdefault(h, {})[w] = c

    def p1(self, w):
        c = self.uni.get(w, 0)
        return self.d1[min(c, KATZ + 1)] * c / self.total if c else self.unknown

    def p2(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        all_ = sum(seen.values())
        kept = sum(self.d2[min(c, KATZ + 1)] * c for c in seen.values())
        all_ += all_ - kept < 1e-9 * all_
        if w in seen:
            return self.d2[min(seen[w], KATZ + 1)] * seen[w] / all_
        return (1 - kept / all_) / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, text):
        own = tokens_of(text)
        return sum(math.log10(max(self.p2(h, w), 1e-300)) for h, w in zip(["START", *own], own, strict=False))


def test_score_by_brute_force(spark):
    docs = spark.read.parquet(D + "sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "never seen words here"), (None, "a b"), (0, "the same id twice")], "doc_id long, text string")
    docs = docs.union(odd).withColumn("block", F.lit("x")).withColumn("count", F.lit(None).cast("int"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = Brute(rows)
    want = sorted((i is None, i or 0, round(model.score(t), 6)) for i, t in rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in score_documents(docs, blocks=4).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_sums_to_one():
    """In every context of a small corpus the seen words and the unknown one share just one."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 200)) for i in range(60)]
    m = Brute(docs)
    for h in [*m.after, "nothing"]:
        assert sum(m.p2(h, w) for w in m.uni) + m.p2(h, "no such word") == pytest.approx(1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_good_turing_is_in_use(spark, sf):
    """On the given tables every discount comes from counts of counts, none from the fallback."""
    words = spark.read.parquet(D + sf + "/documents.parquet").where("crc32(cast(doc_id as string)) % 7 <> 2").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    ladder = {r["c"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d = discounts([ladder.get(r, 0) for r in range(1, TOP + 1)])
    r = np.arange(1, KATZ + 1)
    assert ((d[1:-1] > 0) & (d[1:-1] < 1)).all() and (np.diff(d) > 0).all() and not np.isclose(d[1:-1], (r - 0.5) / r).any()


def test_columns_of_query(spark):
    docs = spark.read.parquet(D + "sf0.001/documents.parquet")
    out = op8_lm_scoring(spark, D + "sf0.001").collect()
    assert len(out) == docs.count() and all(r["held_out"] == held(r["doc_id"]) for r in out) and {r["train_tokens"] for r in out} == {sum(len(tokens_of(r["text"])) for r in docs.collect() if not held(r["doc_id"]))}

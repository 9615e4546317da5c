"""The registered queries over whole small tables: columns, types and the sums that their contracts state."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.quality import crc_mod, fit_pairs, held, sure_labels
from tessera.llm.queries import QUERIES
from tessera.llm.sharding import shuffled_shards, write_shards
from tessera.llm.toxicity import fit_toxicity, score_toxicity

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def result(spark, name):
    out = QUERIES[name](spark, D)
    return dict(out.dtypes), out.collect()


def test_op1(spark, rows):
    kinds, got = result(spark, "op1_token_counts")
    assert {k: kinds[k] for k in ("doc_id", "n_bytes", "n_tokens", "over_limit")} == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert len(got) == len(rows) and all(r["n_bytes"] == len((rows[r["doc_id"]]["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


@pytest.mark.parametrize(("name", "label", "n", "rest", "least"), [("op2_toxicity", "toxic", 4, 2, 0.85), ("op10_quality", "quality", 5, 0, 0.9)])
def test_op2_op10(spark, rows, name, label, n, rest, least):
    kinds, got = result(spark, name)
    assert {k: kinds[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels and labels[r["doc_id"]] is not None]
    assert np.mean([p == y for p, y in known]) >= least


def test_op3(spark, rows):
    kinds, got = result(spark, "op3_jaccard_join")
    assert {k: kinds[k] for k in ("doc_id", "n_shingles", "component_id")} == dict.fromkeys(("doc_id", "n_shingles", "component_id"), "bigint")
    sets = {}
    for i, r in rows.items():
        w = (r["text"] or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + 3]) for p in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root[i]) for i, s in sets.items()}


def test_op5(spark, rows):
    """Every document once, with its own size and checksum; counts at most one apart; slots without gaps."""
    _, got = result(spark, "op5_sharding")
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for i, r in rows.items()}
    shards = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_shards_and_names(spark, tmp_path):
    """Columns with the names of the result and of helpers; shards written with nothing lost."""
    docs = spark.createDataFrame([(i, f"text {i % 7}", "s", 1, 2, 3) for i in range(100)], "doc_id long, text string, shard string, __bucket int, __place int, __every int")
    out = shuffled_shards(docs, 4, bucket_bytes=500)
    assert out.columns == ["doc_id", "text", "__bucket", "__place", "__every", "shard", "slot"] and out.where("__bucket = 1 and __place = 2 and __every = 3").count() == 100
    write_shards(docs, str(tmp_path / "out"), shards=4, bucket_bytes=500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(100)) and {r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {25}


def test_labels_that_differ(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, sure_labels(labels, "quality", F.lit(True)).collect())) == [(2, 1), (4, 0)]
    assert [r["h"] for r in spark.createDataFrame([(None,)], "doc_id long").select(held(5, 0).alias("h")).collect()] == [True]
    assert crc_mod(4) is not None


def test_pairs_are_ranked():
    """Bradley-Terry on one telling feature and one of noise: the order is the feature's, the threshold parts the labels."""
    rng = np.random.default_rng(0)
    x = np.stack([np.r_[rng.normal(-2, 0.4, 200), rng.normal(2, 0.4, 100)], rng.normal(size=300)], 1)
    y = np.r_[np.zeros(200), np.ones(100)]
    s = fit_pairs(x, y).score(x)
    assert ((s >= 0.3) == y).all()


def test_long_sentence_is_one_chain(spark):
    """A toxic word's tag does not depend on how many words without an end of sentence stand before it."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{D}/labels.parquet"))
    hit = score_toxicity(docs, model).where("size(spans) > 0").orderBy(F.desc("score"), "doc_id").join(docs, "doc_id").first()
    word = hit["text"].encode()[hit["spans"][0]["start"] : hit["spans"][0]["end"]].decode().split()[0].strip(".,;:!?")
    tags = []
    for n in range(55, 75):
        w, p = model.tag(pa.array(["plain " * n + word + " and so on" * 30]))
        tags.append(p[n])
    assert np.ptp(tags) < 1e-6


def test_stages_of_odd_tables(spark):
    """Every stage of the pipeline over an empty table and one of nulls, blanks, repeated rows and other columns."""
    names = "doc_id long, text string, lang string, source string, n_chars long, shard int, block string"
    odd = [(1, "a b c d e f g", None, None, None, 1, "x"), (1, "a b c d e f g", None, None, None, 1, "x"), (None, "a b", "en", "s", 3, None, None), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, 2, "y"), (4, " \t\n", "en", "s", 3, 2, "y"), (5, "w " * 5000, "en", "s", 10000, 2, "y")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, names)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            assert out.count() <= len(rows), name
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns

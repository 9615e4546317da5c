import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm.decontaminate import find_benchmark, without_benchmark
from tessera.llm.jaccard import jaccard_components
from tessera.llm.katz import score_documents
from tessera.llm.neighbours import search
from tessera.llm.pieces import PieceModel, StreamingViterbi, decode_pieces, encode_pieces, load_pieces
from tessera.llm.quality import fit_pairs, fit_quality, keep_good, score_quality
from tessera.llm.sharding import shuffled_shards
from tessera.llm.substrings import remove_repeats
from tessera.llm.tokencount import count_tokens
from tessera.llm.toxicity import fit_toxicity, marginals, score_toxicity

D = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, None, None), (4, "", "y"), (5, " \t\n ", "z"), (6, "Ünï <|endoftext|> 😀 don't", "q"), (7, "w " * 30_000, "q"), (None, "a b c d e f g", "n"), (1, "a b c d e f g", "x"), (8, "one", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").withColumn("block", F.lit("b")).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(spark, odd, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for df in (odd, docs):
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_bytes"]) for r in count_tokens(df, P.path("word_bpe_49k.json")).collect())
        assert got == sorted((r["doc_id"] or -1, len(lib.encode(r["text"] or "", add_special_tokens=False).ids), len((r["text"] or "").encode())) for r in df.collect())
    assert count_tokens(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_pieces(spark, odd, docs):
    import sentencepiece

    lib, model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), load_pieces(P.path("piece_bpe_32k.model"))
    for df in (odd, docs.limit(40)):
        out = encode_pieces(df, model)
        want = {r["doc_id"]: lib.encode(r["text"] or "") for r in df.collect()}
        assert all(r["ids"] == want[r["doc_id"]] and r["round_trip"] for r in out.collect())
    assert by_id(decode_pieces(encode_pieces(odd.where("doc_id = 6"), model), model))[6]["text"] == ODD[5][1]
    text = "▁thequickbrownfoxjumpsoverthelazydog" * 4
    assert model.search(text) == lib.encode(text.replace("▁", " ").removeprefix(" "))


def test_unigram_viterbi():
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "abc": -9.0, "c": -1.0}
    m = PieceModel({p: i for i, p in enumerate(scores)}, scores, [], 9, "unigram", [p.encode() for p in scores])
    assert StreamingViterbi(m).run("abcab" * 20) == ["ab", "c", "ab"] * 20


def test_jaccard(spark, odd, docs):
    got = jaccard_components(odd, 3, 90, 100)
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got.collect())
    assert rows == [(0, 5, 1), (1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 2, 6), (7, 1, 7), (8, 1, 8)]
    for options in ({}, {"region_docs": 4, "task_shingles": 2000}):
        got = by_id(jaccard_components(docs, 5, 80, 100, **options))
        sets = {}
        for r in docs.collect():
            w = r["text"].encode().lower().split()
            sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        root = {i: i for i in sets}
        for i in sorted(sets):
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if v == b else v for k, v in root.items()}
        assert {i: (len(s), root[i]) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_sharding(spark, odd, docs):
    for df, n in ((docs, 200), (odd, 10)):
        rows = shuffled_shards(df, 8, bucket_bytes=40_000).collect()
        per = {}
        for r in rows:
            per.setdefault(r["shard"], []).append(r["slot"])
        assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in per.values())
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = shuffled_shards(docs.repartition(7), 8, bucket_bytes=40_000)
    key = lambda d: sorted((r["doc_id"], r["shard"], r["slot"]) for r in d.collect())
    assert key(again) == key(shuffled_shards(docs, 8, bucket_bytes=40_000))
    assert shuffled_shards(docs.limit(0)).count() == 0


def test_decontamination(spark, odd, docs):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    planted = spark.createDataFrame([(10_001, "Before. " + items[0].upper() + " After."), (10_002, "x " + items[1][:60] + "Q" + items[1][60:] + " y"), (10_003, items[2][: len(items[2]) // 2])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_benchmark(docs.select("doc_id", "text").union(planted), bench).collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in r["text"]}
    assert exact | {(10_001, 0), (10_002, 1)} <= got and not any(d == 10_003 for d, _ in got)
    small = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "item_id long, text string")
    assert [(r["start"], r["end"], r["edits"]) for r in find_benchmark(odd, small).collect()] == [(0, 5, 0)] * 4  # only letters count
    assert find_benchmark(odd, small.where("item_id > 1")).count() == 0 and find_benchmark(odd, small.limit(0)).count() == 0
    assert without_benchmark(docs, bench).count() == docs.count() - len({d for d, _ in got if d < 10_000})


def test_substrings(spark, odd, docs):
    shared = " ".join(f"w{i}" for i in range(60))
    extra = spark.createDataFrame([(5001, "alpha " + shared + " omega"), (5002, "beta\n" + shared), (5003, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in df.collect()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for i, r in by_id(remove_repeats(df, blocks=3)).items():
        gone = {q for p in range(len(words[i]) - 49) if first[tuple(words[i][p : p + 50])] < i for q in range(p, p + 50)}
        kept = b" ".join(w for q, w in enumerate(words[i]) if q not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words[i]), len(gone), hashlib.sha256(kept).hexdigest())
    assert sorted(r["n_removed"] for r in remove_repeats(odd, width=5).collect()) == [0] * 9 + [7]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_katz(spark, odd, docs):
    got = by_id(score_documents(docs, blocks=3))
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in docs.collect()}
    count = {}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in count for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # one-word texts: all probabilities after the start sum to one
    few = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "a", "b", "c", "a", "d"])], "doc_id long, text string")
    assert score_documents(odd).count() == 10 and score_documents(docs.limit(0)).count() == 0 and score_documents(few).where("score > 0").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(30)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [None] * 8), (980, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 20 == 0, k=20, leaf_rows=32, task_rows=16, recall=0.97).collect()
    x, hits, seen = {i: np.array(v) for i, v in rows[:430]}, 0, 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted(((-float(sum(a * b for a, b in zip(x[q], v, strict=True))), i) for i, v in x.items() if i != q))[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and q not in {r[1] for r in own}
        hits, seen = hits + len({i for _, i in want} & {r[1] for r in own}), seen + 20
    assert hits / seen >= 0.9 and {r["query_id"] for r in got} == {i for i in x if i % 20 == 0}
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality(spark, odd, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = fit_quality(docs, labels)
    out = score_quality(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in score_quality(odd, model).collect()) and keep_good(docs, model).columns == docs.columns
    assert fit_pairs(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] == pytest.approx(0.8)


def test_toxicity(spark, odd, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = fit_toxicity(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(odd, model).collect())
    assert score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).where("score = 0.5").count() == docs.count()


def test_forward_backward():
    emit, moves = np.array([0.3, -1.0, 2.0, 0.1, -0.5]), np.array([[0.2, -0.4], [0.1, 0.7]])
    got, moved, log_z = marginals(emit, np.array([True, False, False, True, False]), moves)
    z = np.zeros(2)
    want = np.zeros(5)
    for part in (range(3), range(3, 5)):
        total, own = 0.0, np.zeros(5)
        for bits in np.ndindex(*[2] * len(part)):
            s = math.exp(sum(emit[i] * b for i, b in zip(part, bits, strict=True)) + sum(moves[a, b] for a, b in zip(bits, bits[1:], strict=False)))
            total += s
            for i, b in zip(part, bits, strict=True):
                own[i] += s * b
        want += own / total
        z[0] += math.log(total)
    assert got == pytest.approx(want) and log_z == pytest.approx(z[0]) and moved.sum() == pytest.approx(3)



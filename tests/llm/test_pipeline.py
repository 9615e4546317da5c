import corpus_pipeline

from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.store import table

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    first = docs
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = {r["doc_id"] for r in score_quality(docs, fit_quality(docs, table(spark, D, "labels"))).where("score >= 0.3").collect()}
    docs = stages[0](spark, docs, D).cache()
    assert {r["doc_id"] for r in docs.collect()} == good and docs.columns == first.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    docs = stages[1](spark, docs, D).cache()
    assert {r["doc_id"] for r in docs.collect()} == {i for i in root if root[i] == i}
    words = {r["doc_id"]: r["text"].encode().split() for r in docs.collect()}
    firsts, want = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            firsts.setdefault(tuple(words[i][p : p + 50]), i)
    for i, w in words.items():
        gone = {q for p in range(len(w) - 49) if firsts[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        if len(gone) < len(w) or not w:
            want[i] = [x for q, x in enumerate(w) if q not in gone]
    docs = stages[2](spark, docs, D).cache()
    assert {r["doc_id"]: r["text"].encode().split() for r in docs.collect()} == want and docs.columns == first.columns
    items = [r["text"] for r in table(spark, D, "benchmark").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = stages[3](spark, docs, D).cache()
    left = {r["doc_id"] for r in docs.collect()}
    assert not any(t in before[i] for i in left for t in items) and left <= set(before)
    out = stages[4](spark, docs, D).collect()
    assert {r["doc_id"] for r in out} == left and all(r["round_trip"] for r in out)

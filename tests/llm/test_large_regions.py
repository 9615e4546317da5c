import numpy as np

from tessera.llm.jaccard import jaccard_components


def test_large_regions(spark):
    """Chains of near copies far beyond a region's bound, ids with several texts, exact copies: as by brute force."""
    rng = np.random.default_rng(4)
    rows, texts = [], []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(60)]
        for n in range(40):
            words = list(words)
            words[int(rng.integers(60))] = f"x{family}_{n}"  # drifts away from the first
            texts.append(" ".join(words))
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[t]) for i, t in enumerate(order)]
    rows += [(5, texts[3]), (5, texts[90]), (7, "quite another text of its own"), (500, texts[11]), (501, texts[11])]
    sets = [(i, frozenset(zip(w, w[1:], w[2:], strict=False))) for i, t in rows for w in [t.split()]]
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (6, 16_384):
        got = jaccard_components(docs, k=3, num=80, den=100, blocks=3, region_docs=bound).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == root

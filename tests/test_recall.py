import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters
from tessera.operators.knn import nearest
from tessera.plans import more
from tessera.plans.catalog import QUERIES, t

D = "/root/testdata/sf0.001"


def once(fit):
    kept = []

    def run(*a, **k):
        if not kept:
            kept.append(fit(*a, **k))
        return kept[0]

    return run


@pytest.mark.parametrize("name", ["ivf_nearest", "pq_nearest"])
def test_index_recall(spark, monkeypatch, name):
    """The registered searches find 0.9 of the true neighbours of several vectors, the query itself not counted."""
    v = t(spark, D, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding").cache()
    for model in ("kmeans", "ProductCodes"):  # fitted once for all vectors
        monkeypatch.setattr(clusters, model, once(getattr(clusters, model)))
    found = 0
    for i in range(0, 500, 63):
        q = v.where(F.col("id") == i).first()["embedding"]
        monkeypatch.setattr(more, "embedded", lambda *_, q=q: (v, q))
        ids = lambda df, i=i: {r["id"] for r in df.collect()} - {i}
        got = ids(QUERIES[name](spark, D))
        assert len(got) == 9
        found += len(got & ids(nearest(v, q, 10, "l2")))
    assert found >= 0.9 * 8 * 9

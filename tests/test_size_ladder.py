import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog


@pytest.mark.parametrize(("n", "bucket"), [(99_999, "10K<n<100K"), (100_000, "100K<n<1M"), (1_000_000, "1M<n<10M"), (10_000_000, "n>10M")])
def test_size_ladder(spark, monkeypatch, n, bucket):
    monkeypatch.setattr(catalog, "articles", lambda *_: spark.range(n).select(F.lit("place").alias("type")))
    assert [tuple(r) for r in catalog.QUERIES["dataset_card"](spark, "").collect()] == [("place", n, 100.0, bucket)]

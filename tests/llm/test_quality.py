"""The quality model is that of all labelled rows and all pairs of them."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.quality import crc_mod, features, fit_pairs, fit_quality, nth_smallest


def rows_of_two_kinds(good, bad):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0.6, 1, (good, 3)), rng.normal(-0.2, 1.3, (bad, 3))])
    x[:, 2] = np.exp(2 * x[:, 2])  # a long tail: strengths far apart
    return x, np.r_[np.ones(good), np.zeros(bad)]


def test_all_pairs_are_fitted():
    """At the weights, the gradient of the loss over every pair, made one by one, is nil."""
    x, y = rows_of_two_kinds(150, 260)
    model = fit_pairs(x, y)
    z = (x - model.mean) / model.scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    lost = 1 / (1 + np.exp(d @ model.weights))
    assert np.abs(-(lost[:, None] * d).mean(0) + 1e-3 * model.weights).max() < 1e-9
    s = model.strength(x)
    assert (s >= model.threshold).sum() == 150


def test_every_labelled_row_is_fitted(spark):
    """The model of a table of more rows than one batch, or a sample of 20,000, holds is that of all its rows at once."""
    docs = spark.range(0, 30_000).select(
        F.col("id").alias("doc_id"),
        F.expr("concat(repeat(concat('word', id % 97, ' '), int(id % 13)), repeat(if(id % 3 = 0, '| # 12 ', 'Some text. '), int(id % 7)), if(id % 11 = 0, ' AND ! !', ' and'))").alias("text"),
    )
    labels = docs.select("doc_id", F.expr("int((doc_id % 3 > 0) <> (doc_id % 17 = 0))").alias("quality"))
    model = fit_quality(docs, labels)
    known = docs.join(labels, "doc_id").where(crc_mod(5) != 0).toArrow()
    assert known.num_rows > 20_000
    x, y = features(known["text"]), known["quality"].to_numpy()
    want = fit_pairs(x, y)
    np.testing.assert_allclose(model.weights, want.weights, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose([model.slope, model.threshold], [want.slope, want.threshold], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(model.mean, x.mean(0), rtol=1e-9, atol=1e-12)


def test_nth_smallest(spark):
    values = np.r_[np.random.default_rng(1).normal(size=3000), np.full(500, 0.25), 1e9, -1e9, np.nextafter(0.25, 1)]
    df = spark.createDataFrame([(v,) for v in values.tolist()], "s double")
    for n in (1, 2, 1500, 1900, 2200, 3000, 3502, 3503):
        assert nth_smallest(df, n) == np.sort(values)[n - 1]

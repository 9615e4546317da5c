import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clusters


def test_components_of_all_rows(spark):
    """Every row counts, in a table larger than the sample that cells are fitted on."""
    n = clusters.SAMPLE + 10_000
    v = spark.range(n).select("id", F.array(*[(F.rand(i) * (i + 1)).cast("float") for i in range(4)]).alias("embedding")).localCheckpoint()
    x = np.array([r[0] for r in v.select("embedding").collect()], float)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1].T
    want *= np.sign(want[np.arange(4), np.abs(want).argmax(1)])[:, None]
    assert np.allclose(clusters.principal_components(v, 4), want, atol=1e-6)

"""Texts are shuffled once, into their buckets."""

from pyspark.sql import functions as F

from tessera.llm.sharding import shuffled_shards


def test_texts_are_shuffled_once(spark):
    """However large Spark takes the tables to be, the buckets' offsets come to the rows, and the rows stay where their bucket is."""
    docs = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.expr("concat('text ', id)").alias("text"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = shuffled_shards(docs, 8, bucket_bytes=2000)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "BroadcastHashJoin" in above and "Exchange hashpartitioning" not in above
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(8) for i in range(50)]

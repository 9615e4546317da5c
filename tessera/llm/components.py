"""Connected components by alternating large and small stars.

Each round ends in a written table, so a lost executor repeats at most one round. A node of any degree is
reduced to its least neighbour by partial aggregation; its edges are then joined back, where adaptive execution
splits a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.store import discard, written


def with_least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a").withColumn("m", F.least("a", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root`` of every node of the edges (a, b): root is the least id of its component (nodes that are roots are left out)."""
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = with_least(large.where("a <> b"))
        small = down.select("a", F.col("m").alias("b")).union(down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        last, now = now, written(small, "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")

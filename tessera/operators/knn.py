"""Exact nearest neighbours of constant query vectors: a scan with JVM expressions and a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.vectors import cosine_distance, dot, squared_l2


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """``id, distance, score`` of the k nearest; vectors of another dimension take no part."""
    q = literal(query)
    far = {"cosine": cosine_distance, "l2": squared_l2, "dot": lambda a, b: -dot(a, b)}[metric](F.col("embedding"), q)
    score = {"cosine": 1 - F.col("distance"), "l2": 1 / (1 + F.col("distance")), "dot": -F.col("distance")}[metric]
    return vectors.where(F.size("embedding") == len(query)).withColumn("distance", far).withColumn("score", score).orderBy("distance", "id").limit(k)


def nearest_by_partition(vectors: DataFrame, query: list[float], k: int, by: str) -> DataFrame:
    """The best 2k of each partition, then the best k of all."""
    near = vectors.withColumn("distance", cosine_distance(F.col("embedding"), literal(query)))
    per = near.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("distance", "id"))).where(F.col("r") <= 2 * k)
    return per.drop("r").orderBy("distance", "id").limit(k)

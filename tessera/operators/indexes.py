"""Lookup tables of titles, ids and types, and lookups that ask a filter first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.hashes import bloom_filter, maybe_held, title_positions
from tessera.functions.text import title_key
from tessera.operators.storage import last_of_each


def title_index(articles: DataFrame, order: list[Column]) -> DataFrame:
    """``key, id, type``: of articles whose titles have the same key the last one stays. Empty titles have no entry."""
    rows = articles.where("title <> ''").withColumn("key", title_key(F.col("title")))
    return last_of_each(rows, "key", order).select("key", "id", "type")


def id_index(articles: DataFrame, order: list[Column]) -> DataFrame:
    """``id, type, title``; the last row of an id stays."""
    return last_of_each(articles, "id", order).select("id", "type", "title")


def type_index(ids: DataFrame) -> DataFrame:
    """``type, size``: how many ids each type has."""
    return ids.groupBy("type").agg(F.count("*").alias("size"))


def with_presence(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, present`` of each id asked."""
    known = ids.select("id").distinct().withColumn("__there", F.lit(True))
    return asked.select("id").join(known, "id", "left").select("id", F.coalesce("__there", F.lit(False)).alias("present"))


def looked_up(asked: DataFrame, index: DataFrame, keys: int) -> DataFrame:
    """``title, id, type``: titles that the filter surely lacks never reach the join; the others are settled by it."""
    want = asked.select("title", title_key(F.col("title")).alias("key")).distinct()
    bits = bloom_filter(index, "key", lambda c: title_positions(c, keys))
    some = maybe_held(want, title_positions(F.col("key"), keys), bits, "key")
    return asked.join(some.join(index, "key").select("title", "id", "type"), "title", "left").select("title", "id", "type")

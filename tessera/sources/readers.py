"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGE = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long,timestamp:string,text:struct<_VALUE:string,_bytes:long>>"


def read_dump(spark: SparkSession, path: str, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    """Pages of an XML dump (plain, .bz2 or .gz). Pages without a title, id, text or time are left out."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    flat = pages.select("title", "id", "ns", F.col("revision.text._VALUE").alias("text"), F.col("revision.timestamp").alias("timestamp"), F.col("redirect._title").alias("redirect"))
    return flat.dropna(subset=["title", "id", "ns", "text", "timestamp"]).where(F.col("ns").isin(*namespaces))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)

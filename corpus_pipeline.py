"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents``. Rows that a stage rejects are gone from then on;
substring dedup rewrites texts (and ``n_chars``) and drops a document of which no word is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.decontaminate import without_benchmark
from tessera.llm.jaccard import jaccard_components
from tessera.llm.pieces import encode_pieces, load_pieces
from tessera.llm.quality import fit_quality, keep_good
from tessera.llm.store import remove, shared_dir, table, temporary
from tessera.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose Bradley-Terry score reaches the threshold."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8, the document with the least id stays; empty texts and rows without an id stay."""
    found = jaccard_components(docs, k=5, num=80, den=100)
    return docs.join(found.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words covered by 50-word windows that a document with a smaller id holds too."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove_repeats(docs, carry=("text", *rest)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carry0"))
    out = out.select("doc_id", text.alias("text"), *[F.col(f"carry{i}").alias(c) for i, c in enumerate(rest, 1)])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_ids, round_trip`` of each document that is left."""
    import public_tokenizers

    return encode_pieces(docs, load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: No stage but the filters by id can be put in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{i}"
        with temporary(spark):  # what a stage keeps on the way goes when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs

"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly over buckets of about ``bucket_bytes`` by a seeded hash of the id. Pass
two sorts each bucket (arrival order must not matter) and permutes it by a seeded Fisher-Yates. A record's
place in the whole order is its bucket's offset plus its place in the bucket; shard k holds the places from
floor(k n / shards) on, so the shards' row counts differ by at most one (law ``rows``).

Rows without an id are scattered by a hash of their text. Null texts have size 1 and the CRC of no bytes.
Equal rows are interchangeable, each is written. An empty table gives an empty result. Any other columns
travel along, whatever their names, but for ``shard`` and ``slot``, which the result replaces. Only one row per bucket (its count) is gathered for the
offsets, which are broadcast: rows are shuffled once, into their buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.memory import settled
from tessera.llm.store import table



def free(name: str, taken: list[str]) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def bucket_of(buckets: int, seed: int, id_col: str, text_col: str) -> Column:
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed + 1), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    return F.pmod(key, F.lit(buckets)).cast("int")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """The permutation by the classic swaps; all swap targets are drawn at once."""
    out = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), (rng.random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(int).tolist(), strict=True):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffled_shards(df: DataFrame, shards: int = 8, seed: int = 11, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(size) // bucket_bytes))
    df = df.drop("shard", "slot")
    bucket, place, before, every = (free(n, df.columns) for n in ("__bucket", "__place", "__before", "__every"))
    tagged = df.withColumn(bucket, bucket_of(buckets, seed, id_col, text_col))
    counts = tagged.groupBy(bucket).agg(F.count("*").alias(every))
    total = F.sum(every)
    offsets = counts.select(
        bucket,
        (total.over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col(every)).alias(before),
        total.over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(every),
    )
    schema = StructType([*tagged.schema.fields, StructField(place, LongType())])
    sort_by = [id_col, text_col]

    def permute(key: tuple, group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, sort_keys=[(c, "ascending") for c in sort_by])
        swap = fisher_yates(group.num_rows, np.random.default_rng([seed, key[0].as_py()]))
        return group.take(pa.array(order.to_numpy()[swap])).append_column(place, pa.array(np.arange(group.num_rows)))

    mixed = tagged.groupBy(bucket).applyInArrow(settled(permute), schema)
    at = f"(`{place}` + `{before}`)"
    # the offsets go to the rows: a join by shuffle would write every text a second time
    out = mixed.join(F.broadcast(offsets), bucket).withColumn("shard", F.expr(f"(({at} + 1) * {shards} - 1) div `{every}`").cast("int"))
    return out.withColumn("slot", F.expr(f"{at} - (shard * `{every}`) div {shards}")).drop(bucket, place, before, every)


def write_shards(df: DataFrame, path: str, **options: int) -> None:
    """Writes each shard as its own folder. A task writes its buckets where they are, in slot order, as files of the few shards that
    a bucket touches: nothing is gathered for a shard."""
    shuffled_shards(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

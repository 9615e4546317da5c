"""Typed storage: partitioned writes, manifest, exports, upserts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TYPES = ["person", "place", "org", "work", "event", "other"]


def checked_type(c: Column) -> Column:
    return F.when(c.isin(*TYPES), c).otherwise(F.raise_error(F.concat(F.lit("unknown type "), F.coalesce(c, F.lit("null")))))


def write_partitioned(df: DataFrame, path: str, type_col: str = "type", rows_per_file: int = 10_000) -> None:
    """One folder per type. Each task writes its own files: no shuffle, many small types still get few files by adaptive sizes."""
    df.withColumn(type_col, checked_type(F.col(type_col))).write.option("maxRecordsPerFile", rows_per_file).partitionBy(type_col).mode("overwrite").parquet(path)


def manifest(stored: DataFrame, type_col: str = "type") -> DataFrame:
    """Rows, files and bytes of each type, from file metadata."""
    files = stored.groupBy(type_col, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
    return files.groupBy(type_col).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_of_each(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def as_variant(df: DataFrame, column: str = "$data") -> DataFrame:
    return df.withColumn(column, F.parse_json(F.to_json(F.struct(*df.columns))))


# Numbers of files at which a dataset is warned of or refused.
FILE_LEVELS = ((50_000, "warning"), (75_000, "warning"), (90_000, "critical"), (100_000, "error"))
# Infobox fields with columns of their own.
BOX_TEXTS = ("birth_date", "death_date", "country", "founded", "release_date", "start_date", "end_date")


def file_level(files: int) -> str | None:
    """The gravest level that so many files reach; an error is raised."""
    reached = [level for n, level in FILE_LEVELS if files >= n]
    if reached and reached[-1] == "error":
        raise ValueError(f"{files} files; {FILE_LEVELS[-1][0]} are too many")
    return reached[-1] if reached else None


def merged_manifests(manifests: list[DataFrame], type_col: str = "type") -> DataFrame:
    if not manifests:
        raise ValueError("no manifests to merge")
    every = reduce(DataFrame.unionByName, manifests)
    return every.groupBy(type_col).agg(*[F.sum(c).alias(c) for c in ("rows", "files", "bytes")])


def infobox_export(articles: DataFrame) -> DataFrame:
    """A row for each article with an infobox (``id, title, infobox`` as a map); no rows where there is none."""
    field = lambda f: F.element_at("infobox", f)
    digits = F.regexp_extract(F.regexp_replace(field("population"), r"[,\s]", ""), r"^([+-]?\d+)", 1)
    return articles.where("infobox is not null").select(
        F.col("id").alias("article_id"), "title", F.coalesce(F.nullif(field("_type"), F.lit("")), F.lit("unknown")).alias("infobox_type"), F.to_json("infobox").alias("data"),
        *[field(f).alias(f) for f in BOX_TEXTS[:3]], digits.try_cast("bigint").alias("population"), *[field(f).alias(f) for f in BOX_TEXTS[3:]],
    )


def row_size(df: DataFrame, dimensions: int = 0, content: bool = True) -> Column:
    """Estimated bytes of a row: two for each character of its texts, four for each component of its embeddings."""
    defaults = {"id": 10, "title": 30, "type": 6, "wikidata_id": 0, "model_version": 20} | ({"content": 0} if content else {})
    sizes = [F.coalesce(F.length(c), F.lit(n)) * 2 if c in df.columns else F.lit(2 * n) for c, n in defaults.items()]
    return (reduce(lambda a, b: a + b, sizes) + 26 + 4 + 8 + 4 * dimensions).cast("long")


def write_index(df: DataFrame, path: str) -> None:
    """Compressed JSON lines."""
    df.write.option("compression", "gzip").mode("overwrite").json(path)


def merged_index(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of later parts replace those of earlier ones."""
    numbered = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    columns = [c for c in parts[0].columns if c != key]
    last = F.max(F.struct("__part", *columns))
    return numbered.groupBy(key).agg(last.alias("l")).select(key, *[F.col(f"l.`{c}`").alias(c) for c in columns])


def as_lines(df: DataFrame, form: str = "json") -> DataFrame:
    """``line``: rows as JSON, or as CSV with doubled quotes and scores of four places."""
    if form == "json":
        return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    if form != "csv":
        raise ValueError(f"unknown form {form}")
    texts = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if k == "double" else F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if k == "string" else F.col(c).cast("string") for c, k in df.dtypes]
    return df.select(F.array_join(F.array(*[F.coalesce(x, F.lit("")) for x in texts]), ",").alias("line"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Endings of compressed files.
CODECS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "bzip2": "bzip2"}


def codec_of(path: Column) -> Column:
    """The codec that a file's ending names, else ``auto``."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODECS.items() for x in kv]), ending), F.lit("auto"))


def attributes(tag: Column) -> Column:
    """A map of the ``name="value"`` pairs of a tag; of equal names the last counts."""
    names, values = (F.regexp_extract_all(tag, F.lit(r'(\w+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    last = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: ~F.array_contains(F.slice(names, i + 1, F.size(names)), F.element_at(names, i)))
    return F.when(F.size(names) == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(F.transform(last, lambda i: F.element_at(names, i)), F.transform(last, lambda i: F.element_at(values, i))))


def paged(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page with ``total`` and ``has_more``. The total is one row's count, so it does not pass through the sort."""
    limit, offset = (limit if 1 <= limit <= 100 else 20), max(0, offset)
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def batched(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``batch, items``: the rows in arrays of ``size``, in order. Ranges are sorted apart; their counts give each its first number.

    Counts and rows read one stored sort: two runs of a sort may cut their ranges elsewhere.
    """
    parts = df.select(F.struct(*df.columns).alias("item"), *[o.alias(f"__k{i}") for i, o in enumerate(order)]).orderBy(*[f"__k{i}" for i in range(len(order))])
    path = scratch(df.sparkSession, "batches")
    parts.select("item", F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__in")).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    first = counts.withColumn("__before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("__part", "__before")
    at = placed.join(F.broadcast(first), "__part").withColumn("__at", F.col("__before") + F.col("__in"))
    rows = at.groupBy(F.floor(F.col("__at") / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("__at", "item"))).alias("r"))
    return rows.select("batch", F.transform("r", lambda r: r["item"]).alias("items"))


def write_shredded(articles: DataFrame, path: str, fields: dict[str, str]) -> None:
    """Articles with an infobox map: these fields as typed columns of their own (null where a value doesn't fit), and the whole box as VARIANT."""
    own = [F.try_variant_get(F.parse_json(F.to_json("infobox")), f"$.{f}", "string").try_cast(k).alias(f"box_{f}") for f, k in fields.items()]
    articles.select(*[c for c in articles.columns if c != "infobox"], *own, F.parse_json(F.to_json("infobox")).alias("infobox")).write.mode("overwrite").parquet(path)


def write_all_forms(articles: DataFrame, path: str) -> list[str]:
    """The full table as Parquet, JSON lines and CSV, each in a folder of its own."""
    articles.write.mode("overwrite").parquet(f"{path}/parquet")
    for form in ("json", "csv"):
        as_lines(articles, form).write.mode("overwrite").text(f"{path}/{form}")
    return [f"{path}/{form}" for form in ("parquet", "json", "csv")]


def write_vectors(vectors: DataFrame, path: str, order: list[Column]) -> None:
    """Vectors by model and type; of rows with the same id the last stays."""
    last_of_each(vectors, "id", order).write.partitionBy("model", "type").mode("overwrite").parquet(path)


def write_terms(table: DataFrame, path: str) -> None:
    """A lookup table in ranges of sorted terms: a search for a term reads the file, and in it the row group, whose range holds it."""
    table.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)

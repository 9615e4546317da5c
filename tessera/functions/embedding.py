"""Embeddings of texts by a pluggable function, and tables of terms whose embeddings are known."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

from tessera.functions.text import normalise_term

Embed = Callable[[list[str]], np.ndarray]

# Sizes of the embeddings of known models.
DIMENSIONS = {"bge-m3": 1024, "bge-base": 768, "bge-large": 1024, "gemma": 768, "gemma300": 768}
# Which source of a term goes first.
PRIORITY = {"title": 4, "entity": 3, "category": 2, "query": 1}
# Infobox fields that name something.
ENTITY_FIELDS = (
    "name", "birth_name", "birth_place", "death_place", "nationality", "occupation", "employer", "spouse", "children", "parents", "relatives", "location",
    "headquarters", "founder", "director", "author", "artist", "producer", "developer", "publisher", "manufacturer", "country", "city", "state", "region", "capital",
)


def hashing_embedder(dim: int, salt: str = "") -> Embed:
    """Works without a network: words are hashed to signed places; vectors have length one, those of texts without words are zero.
    Where the words of a text cancel out, its least word stands for it."""

    def place(w: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.blake2b(f"{salt}{w}".encode(), digest_size=8).digest(), "little")
        return (h >> 1) % dim, 1 if h & 1 else -1

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            found = re.findall(r"\w+", t.lower())
            for w in found:
                at, sign = place(w)
                out[i, at] += sign
            if found and not out[i].any():
                at, out[i, at] = place(min(found))
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embedding_text(title: Column, content: Column) -> Column:
    """Title and first paragraph, 8000 characters at most."""
    return cut_at_space(F.concat_ws("\n\n", title, F.substring_index(content, "\n\n", 1)))


def cut_at_space(c: Column, size: int = 8000, back: int = 100) -> Column:
    """The first ``size`` characters; a longer text ends at the last space among the last ``back`` of them, where there is one."""
    head = F.substring(c, 1, size)
    space = size - F.locate(" ", F.reverse(head))  # its place from 0
    at_space = (F.locate(" ", F.reverse(head)) > 0) & (space > size - back)
    return F.when(F.length(c) <= size, c).when(at_space, F.substr(head, F.lit(1), space)).otherwise(head)


def with_embeddings(df: DataFrame, text: str, embed: Embed, batch: int = 32, one_by_one: bool = True) -> DataFrame:
    """Adds ``embedding`` and ``embed_error``. Every row stays.

    Where a batch fails, its texts are tried one by one; a text that fails alone has a null vector and the error.
    Null texts have neither.
    """
    schema = StructType([*df.schema.fields]).add("embedding", ArrayType(FloatType())).add("embed_error", StringType())

    def one(texts: list[str]) -> tuple[list, list]:
        try:
            return [v.tolist() for v in np.asarray(embed(texts), np.float32)], [None] * len(texts)
        except Exception as e:  # noqa: BLE001  what fails is the caller's function
            if len(texts) == 1 or not one_by_one:
                return [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)
            parts = [one([t]) for t in texts]
            return [v for p, _ in parts for v in p], [x for _, p in parts for x in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(text).to_pylist()
                here = [i for i, t in enumerate(texts) if t is not None]
                vectors, errors = [None] * len(texts), [None] * len(texts)
                for i, v, e in zip(here, *(one([texts[i] for i in here]) if here else ([], [])), strict=True):
                    vectors[i], errors[i] = v, e
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*part.schema.names, "embedding", "embed_error"])

    return df.mapInArrow(run, schema)


def extracted_terms(articles: DataFrame) -> DataFrame:
    """``term, normalized, source, id`` from ``id, title, categories, infobox``; entities have two characters at least."""
    entities = F.filter(F.array(*[F.element_at("infobox", f) for f in ENTITY_FIELDS]), lambda x: F.length(x) >= 2)
    of = lambda source, items: F.transform(items, lambda x: F.struct(x.alias("term"), F.lit(source).alias("source")))
    none = F.array().cast("array<string>")
    items = F.concat(of("title", F.array("title")), of("category", F.coalesce("categories", none)), of("entity", F.coalesce(entities, none)))
    terms = articles.select("id", F.inline(items)).withColumn("normalized", normalise_term("term"))
    return terms.where((F.length("normalized") >= F.when(F.col("source") == "entity", 2).otherwise(1))).select("term", "normalized", "source", "id")


def unique_terms(terms: DataFrame) -> DataFrame:
    """One row for each normalised term: the source that goes first, then the least id and term. Partial sums before the shuffle."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("source"))
    first = F.min(F.struct((-rank).alias("p"), "id", "term", "source"))
    return terms.groupBy("normalized").agg(first.alias("f")).select("normalized", "f.term", "f.source", "f.id")


def looked_up(queries: DataFrame, table: DataFrame, key: str = "normalized") -> DataFrame:
    """Every query with ``embedding`` and ``hit``; the table has one row for each key."""
    known = table.select(key, "embedding", F.lit(True).alias("hit"))
    return queries.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def embedded_terms(queries: DataFrame, table: DataFrame, embed: Embed, key: str = "normalized") -> DataFrame:
    """Known embeddings from the table; only the distinct rest goes to the model."""
    rest = with_embeddings(queries.join(table, key, "left_anti").select(key).distinct(), key, embed).select(key, "embedding")
    return looked_up(queries, table, key).join(rest.withColumnRenamed("embedding", "fresh"), key, "left").withColumn("embedding", F.coalesce("embedding", "fresh")).drop("fresh")


def hit_stats(found: DataFrame) -> DataFrame:
    n, hits = F.count("*"), F.count_if("hit")
    return found.agg(n.alias("lookups"), hits.alias("hits"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate"))

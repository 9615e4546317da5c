"""Relationship edges and lookups over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import place, title_key, wiki_title

# Predicates and their reverses.
REVERSE = {
    "links_to": "linked_from", "born_in": "birthplace_of", "died_in": "deathplace_of", "member_of": "has_member",
    "created_by": "creator_of", "occurred_at": "event_location", "located_in": "contains", "headquartered_at": "headquarters_of",
}


def forward_edges(links: DataFrame, titles: DataFrame) -> DataFrame:
    """``from_id, predicate, to_id, to_title``: links (from_id, predicate, to_title) whose title is known (titles: id, title)."""
    keyed = titles.select(F.col("id").alias("to_id"), title_key(F.col("title")).alias("key"))
    return links.withColumn("key", title_key(F.col("to_title"))).join(keyed, "key").select("from_id", "predicate", "to_id", "to_title").distinct()


def reverse_edges(forward: DataFrame, titles: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in REVERSE.items() for x in kv])
    other = F.coalesce(F.element_at(table, F.col("predicate")), F.concat(F.lit("reverse_"), F.col("predicate")))
    named = titles.select(F.col("id").alias("from_id"), F.col("title").alias("from_title"))
    return forward.join(named, "from_id").select("to_id", other.alias("reverse_predicate"), "from_id", "from_title")


# Infobox fields that name a related article.
FIELD_PREDICATES = {
    "birth_place": "born_in", "death_place": "died_in", "employer": "member_of", "location": "located_in", "headquarters": "headquartered_at",
    "author": "created_by", "creator": "created_by", "director": "created_by", "composer": "created_by", "artist": "created_by",
}


def extracted_edges(articles: DataFrame) -> DataFrame:
    """``from_id, predicate, to_title`` from ``id, content, infobox``: links first, then infobox fields; a title counts once for each article."""
    linked = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1)), wiki_title)))
    named = F.filter(F.array(*[F.struct(place(F.element_at("infobox", f)).alias("t"), F.lit(p).alias("p")) for f, p in FIELD_PREDICATES.items()]), lambda x: x["t"].isNotNull())
    none = F.array().cast("array<string>")
    src = articles.select(F.col("id").alias("from_id"), F.coalesce(linked, none).alias("linked"), F.coalesce(named, F.array().cast("array<struct<t:string,p:string>>")).alias("named"))
    # ten fields at most: the position in their own list tells a repeated title
    titles = F.transform("named", lambda x: x["t"])
    fresh = F.filter("named", lambda x, i: ~F.array_contains("linked", x["t"]) & (F.array_position(titles, x["t"]) == i + 1))
    every = F.concat(F.transform("linked", lambda x: F.struct(F.lit("links_to").alias("predicate"), x.alias("to_title"))), F.transform(fresh, lambda x: F.struct(x["p"].alias("predicate"), x["t"].alias("to_title"))))
    return src.select("from_id", F.inline(every))


def relationships(forward: DataFrame, reverse: DataFrame, id: object, direction: str = "both", predicate: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:  # noqa: A002
    """``direction, predicate, other_id, other_title`` of an article's edges, a page of them in a fixed order."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction}")
    out = forward.where(F.col("from_id") == id).select(F.lit("outgoing").alias("direction"), "predicate", F.col("to_id").alias("other_id"), F.col("to_title").alias("other_title"))
    into = reverse.where(F.col("to_id") == id).select(F.lit("incoming").alias("direction"), F.col("reverse_predicate").alias("predicate"), F.col("from_id").alias("other_id"), F.col("from_title").alias("other_title"))
    found = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    found = found if predicate is None else found.where(F.col("predicate") == predicate)
    return found.orderBy(F.desc("direction"), "predicate", "other_id", "other_title").offset(max(0, offset)).limit(limit)


def write_edges(edges: DataFrame, path: str, key: str, rows_per_file: int = 100_000) -> None:
    """Files hold ranges of the key, sorted, so that a lookup reads few row groups."""
    edges.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)

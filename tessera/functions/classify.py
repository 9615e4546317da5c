"""Article types from infobox names, categories and text, as column expressions.

Exact infobox names are a parameter (``names``: type to list of lower-case names, for example read from a JSON file);
the patterns below apply with or without them.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

TYPES = ("person", "place", "org", "work", "event", "other")

# Patterns on infobox names.
INFOBOX_PATTERNS = {
    "person": [
        r"^(basketball|baseball|football|hockey|soccer|cricket|rugby)\s+(player|biography)", r"^(nfl|nba|mlb|nhl|mls)\s+", r"player$", r"biography$",
        r"^(office ?holder|officeholder)$", r"^(governor|senator|representative|congressman|minister)$",
    ],
    "place": [
        r"^(us|uk|australian|canadian|french|german|indian|chinese|japanese)\s+(city|state|county|town)", r"\s+(city|town|village|county|district|station|airport|park)$",
        r"^(settlement|place)", r"^(nrhp|historic)",
    ],
    "org": [
        r"^(sports?\s*)?(team|club|franchise)$", r"^(football|basketball|baseball|hockey|soccer)\s+(club|team)$", r"\s+(fc|united|city|rovers)$",
        r"(company|corporation|inc|ltd|llc)$",
    ],
    "work": [
        r"^(album|single|song|film|movie|book|novel|game)$", r"\s+(album|single|film|movie|series|show)$",
        r"^(korean|japanese|chinese|indian|british|american)\s+(film|drama|series)", r"^(video|computer|mobile)\s*game$",
    ],
    "event": [
        r"\s+(war|battle|conflict|disaster|election|championship)$", r"^(\d{4})\s+(olympics|world cup|election)", r"^(summer|winter)\s+(olympics|games)",
    ],
    "other": [r"^(species|taxon|genus|family|order|phylum|kingdom)", r"^(dog|cat|horse|bird|fish|insect)\s+breed$"],
}

# Patterns on the categories, joined by spaces.
CATEGORY_PATTERNS = {
    "person": [
        r"\b(born|died|living people|deaths|births)\b", r"\b(actors|actresses|musicians|politicians|athletes|writers|scientists)\b",
        r"\b(people from|alumni of|graduates of)\b",
    ],
    "place": [
        r"\b(cities|towns|villages|counties|districts|geography|populated places)\b", r"\b(buildings|structures|landmarks|national parks|protected areas)\b",
        r"\b(located in|in .* county)\b",
    ],
    "org": [r"\b(companies|organizations|institutions|universities|schools|teams)\b", r"\b(founded in|established in|nonprofit|corporation)\b"],
    "work": [r"\b(albums|films|books|novels|video games|television series)\b", r"\b(released in|published in|directed by)\b"],
    "event": [r"\b(wars|battles|conflicts|disasters|elections|championships)\b", r"\b(\d{4} in |events of)\b"],
}

# Signs of a biography in the first 1000 characters.
LIFE_DATES = r"\b(born|b\.|d\.).*\d{4}\b"
PROFESSION = (
    r"\b(is|was)\s+an?\s+(american|british|french|german|japanese|chinese|indian|canadian|australian)?\s*"
    r"(actor|actress|singer|musician|politician|writer|author|scientist|athlete|player|director|artist|businessman|entrepreneur|activist|journalist|philosopher|historian)"
)
PRONOUNS = r"\b(he|she|his|her|him|they|their)\b"

Names = dict[str, list[str]]


def read_names(path: str) -> Names:
    """Exact infobox names from a JSON file: an object of type to list."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if unknown := set(found) - set(TYPES):
        raise ValueError(f"unknown types {sorted(unknown)}")
    return {kind: [n.lower() for n in names] for kind, names in found.items()}


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def exact(box: Column, kind: str, names: Names | None) -> Column:
    listed = (names or {}).get(kind, [])
    return F.coalesce(F.lower(box).isin(*listed), F.lit(False)) if listed else F.lit(False)


def by_pattern(box: Column, kind: str) -> Column:
    return any_of([has(F.lower(box), p) for p in INFOBOX_PATTERNS[kind]])


def by_category(categories: Column, kind: str) -> Column:
    joined = F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")
    return any_of([has(joined, p) for p in CATEGORY_PATTERNS.get(kind, [])])


def probably_person(text: Column) -> Column:
    head = F.substring(text, 1, 1000)
    pronouns = F.regexp_count(F.substring_index(head, "\n", 1), F.lit(f"(?i){PRONOUNS}"))
    return has(head, LIFE_DATES) | has(head, PROFESSION) | F.coalesce(pronouns >= 3, F.lit(False))


def article_type(box: Column, categories: Column, text: Column, names: Names | None = None) -> Column:
    """The first type that the infobox name, then the categories, then the text speak for."""
    tests = [(exact(box, k, names) | by_pattern(box, k), k) for k in TYPES]
    tests += [(by_category(categories, k), k) for k in TYPES if k != "other"] + [(probably_person(text), "person")]
    return F.coalesce(*[F.when(test, kind) for test, kind in tests], F.lit("other"))


def confidence(box: Column, names: Names | None = None) -> Column:
    """high: a listed infobox name; medium: a pattern on it; low: anything else."""
    listed, matched = any_of([exact(box, k, names) for k in TYPES]), any_of([by_pattern(box, k) for k in TYPES])
    return F.when(listed, "high").when(matched, "medium").otherwise("low")


def type_scores(box: Column, categories: Column, text: Column, names: Names | None = None) -> Column:
    """A struct of points: 100 for a listed name, 80 and 30 for each pattern on name and categories, 20 for a biography."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    joined = F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")
    raw = {}
    for k in TYPES:
        parts = [points(exact(box, k, names), 100), *[points(has(F.lower(box), p), 80) for p in INFOBOX_PATTERNS[k]], *[points(has(joined, p), 30) for p in CATEGORY_PATTERNS.get(k, [])]]
        raw[k] = reduce(add, parts + ([points(probably_person(text), 20)] if k == "person" else []))
    none = reduce(lambda a, b: a & b, [v == 0 for v in raw.values()])
    raw["other"] = F.when(none, 1).otherwise(raw["other"])
    return F.struct(*[raw[k].cast("int").alias(k) for k in TYPES])


def simple_type(boxes: Column, categories: Column, words: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The plainer classifier: for each type in turn, substrings of any infobox name, then substrings of any category."""
    inside = lambda items, parts: F.coalesce(F.exists(items, lambda x: any_of([F.contains(F.lower(x), F.lit(p)) for p in parts])), F.lit(False))
    tests = [F.when(inside(boxes, names), kind) for kind, (names, _) in words.items()] + [F.when(inside(categories, cats), kind) for kind, (_, cats) in words.items()]
    return F.coalesce(*tests, F.lit("other"))

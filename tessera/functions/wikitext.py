"""Wikitext: the regular parts as column expressions, nested templates and sections as one Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

SKIPPED = "(?i)^(https?:|category:|file:|image:|template:|wikipedia:|wp:|help:|portal:|draft:)"
SECTION = StructType().add("title", StringType()).add("depth", IntegerType()).add("text", StringType())
PARSED = StructType().add("infobox_type", StringType()).add("infobox", MapType(StringType(), StringType())).add("sections", ArrayType(SECTION)).add("templates", ArrayType(StringType()))


def links(c: Column) -> Column:
    """``array<struct<page, text>>`` of internal links, first one of each page, anchors cut off."""
    raw = F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    pairs = F.transform(raw, lambda r: F.struct(F.trim(F.substring_index(F.substring_index(r, "|", 1), "#", 1)).alias("page"), F.trim(F.element_at(F.split(r, r"\|", 2), -1)).alias("text")))
    kept = F.filter(pairs, lambda p: (p["page"] != "") & ~p["page"].rlike(SKIPPED))
    return F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda q: F.lower(q["page"])), F.lower(p["page"])) == i + 1)


def categories(c: Column) -> Column:
    """Names without sort keys, first occurrence of each."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\[\[\s*category\s*:\s*([^\]|]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def redirect_target(c: Column) -> Column:
    t = F.regexp_extract(c, r"(?i)^\s*#(?:redirect|weiterleitung|redirección|redirection|перенаправление|rinvia|patrz)\s*:?\s*\[\[([^\]|#]+)", 1)
    return F.when(t != "", F.trim(t))


def short_description(c: Column) -> Column:
    t = F.regexp_extract(F.substring(c, 1, 2000), r"(?i)\{\{\s*short description\s*\|\s*([^|}]+)", 1)
    return F.when(t != "", F.trim(t))


def preprocessed(c: Column) -> Column:
    """Comments and magic words removed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), "__(NOTOC|NOEDITSECTION|FORCETOC|TOC)__", "")


def bare_title(c: Column) -> Column:
    """The title from the leading bold text."""
    t = F.regexp_extract(c, r"'''([^']+)'''", 1)
    return F.when(t != "", t)


def templates_of(text: str) -> list[str]:
    """Bodies of outermost templates by brace depth."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two == "{{":
            if not depth:
                at = i + 2
            depth += 1
            i += 2
        elif two == "}}" and depth:
            depth -= 1
            if not depth:
                out.append(text[at:i])
            i += 2
        else:
            i += 1
    return out


def parameters(body: str) -> tuple[str, dict[str, str]]:
    """A template's name and parameters; bars inside links and inner templates do not split."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("[[", "{{"):
            depth += 1
            i += 2
            continue
        if two in ("]]", "}}"):
            depth -= 1
            i += 2
            continue
        if body[i] == "|" and depth <= 0:
            parts.append(body[start:i])
            start = i + 1
        i += 1
    parts.append(body[start:])
    out, n = {}, 0
    for p in parts[1:]:
        key, eq, value = p.partition("=")
        if eq and re.fullmatch(r"[\w\s\-.]+", key.strip()):
            out[key.strip()] = value.strip()
        else:
            n += 1
            out[str(n)] = p.strip()
    return parts[0].strip(), out


@F.pandas_udf(PARSED)
def parse(s: pd.Series) -> pd.DataFrame:
    rows = []
    for text in s:
        text = re.sub("(?s)<!--.*?-->", "", text or "")
        named = [parameters(b) for b in templates_of(text)]
        box = next(((n, p) for n, p in named if n.lower().startswith(("infobox", "taxobox", "speciesbox"))), (None, {}))
        heads = list(re.finditer(r"(?m)^(={2,6})\s*(.*?)\s*\1\s*$", text))
        ends = [h.start() for h in heads] + [len(text)]
        sections = [{"title": "", "depth": 0, "text": text[: ends[0]].strip()}] + [{"title": h[2], "depth": len(h[1]) - 2, "text": text[h.end() : ends[i + 1]].strip()} for i, h in enumerate(heads)]
        kind = re.sub(r"(?i)^infobox\s+", "", box[0]).lower().replace("_", " ").strip() if box[0] else None
        rows.append((kind, box[1] or None, sections, [n for n, _ in named]))
    return pd.DataFrame(rows, columns=["infobox_type", "infobox", "sections", "templates"])

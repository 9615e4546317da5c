"""Hashes that other systems' files use; inside the engine xxhash64 is the choice."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, LongType


def fnv1a(data: bytes, bits: int = 64, seed: int | None = None) -> int:
    h, prime = (0xCBF29CE484222325, 0x100000001B3) if bits == 64 else (0x811C9DC5, 0x01000193)
    h = h if seed is None else h ^ seed
    for b in data:
        h = (h ^ b) * prime % (1 << bits)
    return h


def djb2(text: str) -> int:
    h = 5381
    for c in text:
        h = (h * 33 + ord(c)) % (1 << 32)
    return h


@F.pandas_udf(DecimalType(20, 0))
def fnv1a_64(s: pd.Series) -> pd.Series:
    from decimal import Decimal

    return s.map(lambda t: Decimal(fnv1a(t.encode())), na_action="ignore")


def folded_units(texts: pd.Series, step: Callable[[np.ndarray, np.ndarray], np.ndarray], start: int) -> pd.Series:
    """A 32-bit fold over the UTF-16 units of each text, a place of all texts at a time; longest first, so none is padded. Nulls stay."""
    out = pd.Series(pd.array([None] * len(texts), "Int64"), index=texts.index)
    for at in range(0, len(texts), 1024):
        here = texts.iloc[at : at + 1024].dropna()
        raw = here.map(lambda t: t.encode("utf-16-le"))
        size = raw.str.len().to_numpy(np.int64) // 2
        order = np.argsort(-size, kind="stable")
        units = np.frombuffer(b"".join(raw), "<u2").astype(np.uint64)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        h, left = np.full(len(here), start, np.uint64), len(here)
        for i in range(int(size[0]) if len(size) else 0):
            left = int(np.searchsorted(-size[:left], -i, "left"))  # those with more than i units
            h[:left] = step(h[:left], units[begin[:left] + i])
        back = np.empty(len(here), np.int64)
        back[order] = h
        out.loc[here.index] = back
    return out


@F.pandas_udf(LongType())
def djb2_32(s: pd.Series) -> pd.Series:
    return folded_units(s, lambda h, x: (h * np.uint64(33) + x) & np.uint64(0xFFFFFFFF), 5381)


@F.pandas_udf(LongType())
def fnv1a_32(s: pd.Series) -> pd.Series:
    """Over UTF-16 units, as a number without sign."""
    return folded_units(s, lambda h, x: (h ^ x) * np.uint64(16777619) & np.uint64(0xFFFFFFFF), 2166136261)


def fnv1a_32_rounded(text: str) -> int:
    """The same in floating point, whose products lose what is beyond 53 bits: the form in stored title filters."""
    h = 2166136261
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h ^= int.from_bytes(units[i : i + 2], "little")
        h = int(float(h - (1 << 32) if h >= 1 << 31 else h) * 16777619.0) % (1 << 32)
    return h


@F.pandas_udf(LongType())
def fnv1a_32_float(s: pd.Series) -> pd.Series:
    return s.map(fnv1a_32_rounded, na_action="ignore").astype("Int64")


def bloom_positions(h1: Column, h2: Column, bits: int, hashes: int, modulus: int | None = None) -> Column:
    """Double hashing: (h1 + i h2) mod bits for each i; sums wrap at ``modulus`` first, where given."""
    total = lambda i: (h1 + i * h2) % modulus if modulus else h1 + i * h2
    return F.array(*[total(F.lit(i).cast("long")) % bits for i in range(hashes)])


def title_positions(title: Column, keys: int) -> Column:
    """The bits of a title in a filter of ten bits a key and seven hashes."""
    return bloom_positions(fnv1a_32(title), fnv1a_32(F.concat(title, title)), 10 * keys, 7)


def term_positions(normalised: str, hashes: int, bits: int) -> list[int]:
    """The bits of a normalised term: 64-bit hashes of it and of it with a zero character behind."""
    h1, h2 = fnv1a(normalised.encode()), fnv1a((normalised + "\0").encode())
    return [(h1 + i * h2) % (1 << 64) % bits for i in range(hashes)]


def bloom_filter(keys: DataFrame, key: str, positions: Callable[[Column], Column]) -> DataFrame:
    """The set bits, ``bit``: a table, so it is as large as the keys need and is made where they are. Equal keys are hashed once, and
    the distinct ones are dealt to all tasks before that."""
    return keys.select(key).distinct().select(F.explode(positions(F.col(key))).alias("bit")).distinct()


def maybe_held(asked: DataFrame, positions: Column, bits: DataFrame, key: str) -> DataFrame:
    """The rows all of whose bits are set; the others are surely not among the keys."""
    want = asked.select(key, F.explode(F.array_distinct(positions)).alias("bit"))
    missing = want.join(bits, "bit", "left_anti").select(key).distinct()
    return asked.join(missing, key, "left_anti")


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and number of hashes of a Bloom filter for n keys at a false positive rate p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))

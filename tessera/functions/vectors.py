"""Vector arithmetic on ``array<float>`` columns, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """Two zero vectors are at 0, one zero vector at 1."""
    na, nb = norm(a), norm(b)
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - near)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def quantised(v: Column) -> Column:
    """Components in [-1, 1] as integers 0 to 255, halves up."""
    return F.transform(doubles(v), lambda x: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) * 127.5 + 0.5).cast("int"))


def euclidean_score(distance: Column) -> Column:
    return F.exp(-distance)


def min_max_quantised(v: Column) -> Column:
    """Components from the vector's own least to its largest as 0 to 255, halves up; all 0 where they are equal."""
    d = doubles(v)
    low, high = F.array_min(d), F.array_max(d)
    width = F.when(high == low, 1.0).otherwise(high - low)
    return F.transform(d, lambda x: F.floor((x - low) / width * 255 + 0.5).cast("int"))


def dequantised(q: Column) -> Column:
    return F.transform(q, lambda x: (x - 128) / 127.5)


def quantised_cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors of 0 to 255 about 128; 0 for a zero vector, an error for different sizes."""
    centred = lambda v: F.transform(v, lambda x: (x - 128).cast("double"))
    x, y = centred(a), centred(b)
    size = norm(x) * norm(y)
    near = F.when(size == 0, 0.0).otherwise(dot(x, y) / size)
    return F.when(F.size(a) == F.size(b), near).otherwise(F.raise_error(F.lit("vectors of different sizes")))

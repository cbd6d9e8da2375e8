"""Algebra of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays so."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (an array of arrays) where the mask is 1; their sum of none over 1, so zeros, where it is nowhere."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1.0))
    weighed = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zeros = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(weighed, zeros, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / n)

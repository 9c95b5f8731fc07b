"""Expressions on arrays as vectors, bags and distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared part of two bags without repeats; two empty ones give `empty`."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / u)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def surprise(generic: Column, generic_total: Column, own: Column, own_total: Column, eps: float = 1e-7) -> Column:
    """How much more a token belongs to the generic baseline than to the corpus."""
    return F.ln(generic / generic_total + eps) - F.ln(own / own_total + eps)

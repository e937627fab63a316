"""Distances between array columns, as Column expressions that accumulate in double precision.

Arrays of different length raise an error, as does a null element; a null array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))).otherwise(value)


def _fold(a: Column, b: Column, f) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return _checked(a, b, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def dot_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos, not below 0; 1 if either norm is 0."""
    na, nb = F.sqrt(dot_product(a, a)), F.sqrt(dot_product(b, b))
    return F.when((na == 0) | (nb == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot_product(a, b) / (na * nb)))


METRICS = {"dot": dot_product, "l2": l2_distance, "l1": l1_distance, "cosine": cosine_distance}


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])

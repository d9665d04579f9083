"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid import constants as K


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    from motorgrid.functions.text import let

    return let(norm(vec), lambda n: F.when(n > 0, F.transform(as_double(vec), lambda x: x / n))
               .otherwise(as_double(vec)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(K.COSINE_EPSILON))

"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit_vector(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    wide = F.transform(a, lambda x: x.cast("double"))
    norm = F.array(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)))
    # the norm is bound once, then divides every component
    return F.element_at(
        F.transform(norm, lambda n: F.transform(wide, lambda x: F.when(n > 0, x / n).otherwise(0.0))), 1
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)

"""Dense-vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda v: v.cast("double"))).otherwise(
        F.transform(a, lambda v: v / length)
    )


def pair_features(a: Column, b: Column) -> Column:
    """|a-b|, a*b and (a+b)/2 side by side."""
    return F.concat(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2),
    )

"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length one; null for empty and zero vectors and such with nulls."""
    v = v.cast("array<double>")
    return F.when((F.size(v) > 0) & (norm(v) > 0), let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    """The dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

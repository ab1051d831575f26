"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuquarry.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    # both are bound first, as a lambda computes what it names again for every component
    return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))))


def truncated(a: Column, width: int) -> Column:
    return unit(F.slice(a, 1, width))


def is_sound(a: Column, width: int) -> Column:
    """Of the right width, without nulls, NaN or infinities."""
    return F.coalesce((F.size(a) == width) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

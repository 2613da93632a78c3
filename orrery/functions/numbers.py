"""Scalar and vector arithmetic, inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of the watch histogram (fixed values).
HISTOGRAM_EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 40, 60, 100, 200, 500, 1000)


def xdiv(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return xdiv(dot(a, b), norm(a) * norm(b))


def bucket(v: Column) -> Column:
    """The first edge of the histogram that is at least v; null beyond the last."""
    out = F.lit(None).cast("int")
    for e in reversed(HISTOGRAM_EDGES):
        out = F.when(v <= e, F.lit(e)).otherwise(out)
    return out


def day_number(d: Column) -> Column:
    """Days since 2007-01-01."""
    return F.datediff(d, F.lit("2007-01-01").cast("date"))

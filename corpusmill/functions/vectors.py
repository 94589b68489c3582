"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """Unit length in double precision, as floats; the zero vector stays zero."""
    scale = F.greatest(norm(v), F.lit(floor))
    return F.element_at(F.transform(F.array(scale), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float"))), 1)


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))

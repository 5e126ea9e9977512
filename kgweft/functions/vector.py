"""Vector arithmetic on arrays, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, floor: float = 1e-9) -> Column:
    """Unit length; the norm counts as ``floor`` at least, so a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for vectors of different lengths, empty ones and zero vectors."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def rescaled(score: Column, scale: str = "cosine") -> Column:
    """``cosine`` as it is, or ``unit`` for (1 + cosine) / 2."""
    return (score + 1) / 2 if scale == "unit" else score

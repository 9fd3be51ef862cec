"""Vector column expressions built from higher-order array functions.

These stay in the JVM and are fine for per-row work (norms, one distance per row of an
equi-joined pair). Many-to-many distance work goes through
:mod:`cachelens.operators.vector_join` instead, which batches rows into Arrow blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_l2(a, b) -> Column:
    """Squared L2 distance in double precision (never the square root)."""
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(a) -> Column:
    return F.sqrt(norm_sq(a))


def has_nan(a) -> Column:
    return F.exists(_c(a), lambda x: F.isnan(x))


def cosine_quality(d) -> Column:
    """``clip(1 - d/2, 0, 1)``: cosine similarity of unit vectors from squared L2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - _c(d) / F.lit(2.0)))

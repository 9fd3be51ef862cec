"""Latency and throughput statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators.quantiles import exact_percentiles


def latency_stats(df: DataFrame, value_col: str, group_cols=(), scale: float = 1.0) -> DataFrame:
    """mean, std(pop), p50/p95/p99 (exact, linear interpolation), min, max of ``value * scale``
    (``scale = 1e-6`` turns ns into ms). The percentiles come from value counts."""
    v = F.col(value_col).cast("double") * F.lit(float(scale))
    group_cols = list(group_cols)
    base = df.groupBy(*group_cols).agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), 4).alias("mean_ms"), F.round(F.stddev_pop(v), 4).alias("std_ms"),
        F.round(F.min(v), 4).alias("min_ms"), F.round(F.max(v), 4).alias("max_ms"))
    pct = exact_percentiles(df, v, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, group_cols) \
        .select(*[F.col(c).alias(f"_{c}") for c in group_cols], *[F.round(p, 4).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")])
    same = F.lit(True)
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = base.join(pct, same, "left") if group_cols else base.crossJoin(pct)  # one row each
    return joined.select(*group_cols, "n", "mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")


def throughput(df: DataFrame, ts_col: str, group_cols=()) -> DataFrame:
    """rows / elapsed seconds between the first and last timestamp; inf when elapsed <= 0."""
    ts = F.col(ts_col).cast("timestamp")
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1e6)
    n = F.count(F.lit(1))
    return df.groupBy(*group_cols).agg(
        n.alias("n"), F.round(span, 6).alias("elapsed_s"),
        F.round(F.when(span > 0, n / span).otherwise(F.lit(float("inf"))), 6).alias("per_second"))

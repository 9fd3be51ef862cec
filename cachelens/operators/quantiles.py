"""Exact percentiles from value counts.

Equal values are counted first, in the map tasks already, so a value that most rows share is one row
with a weight afterwards. A percentile lies between two ranks, and a rank belongs to the value whose
running weight covers it. The running weights come from one window while the distinct values are few
(they are counted), and from range-partitioned prefix sums beyond that; ``percentile()`` would
keep all distinct values of a group in one aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.operators.ordering import running_sum
from cachelens.session import materialize

#: Distinct (group, value) rows that a window may take in as one partition.
WINDOW_ROWS = 500_000


def value_counts(df: DataFrame, value: Column, group_cols=()) -> DataFrame:
    """``_q0, .., _v, _n``: how often each value (nulls left out) is found in each group, written once."""
    groups = [F.col(c).alias(f"_q{i}") for i, c in enumerate(group_cols)]
    vals = df.select(*groups, value.cast("double").alias("_v")).filter("_v is not null")
    return materialize(vals.groupBy(*vals.columns).agg(F.count(F.lit(1)).alias("_n")), "value-counts")


def running_weights(counts: DataFrame, groups: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``counts`` with ``_before``, the weight of the smaller values of the group."""
    if counts.count() <= window_rows:
        order = Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return running_sum(counts, ["_v"], "_n", "_before", partition_by=groups or None)


def exact_percentiles(df: DataFrame, value: Column, wanted: dict[str, float], group_cols=(), window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``(*group_cols, *wanted)``: linear interpolation between closest ranks, nulls left out;
    ``wanted`` maps output columns to shares in [0, 1]. Without groups one row, always."""
    groups = [f"_q{i}" for i in range(len(group_cols))]
    counts = value_counts(df, value, group_cols)
    placed = running_weights(counts, groups, window_rows)
    if groups:
        totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total")).select(*[F.col(g).alias(f"{g}t") for g in groups], "_total")
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}t"))
        placed = placed.join(totals, same)
    else:
        placed = placed.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    picks = [F.max("_total").alias("_total")]
    for i, share in enumerate(wanted.values()):
        low = (F.lit(float(share)) * (F.col("_total") - 1)).cast("long")
        for name, rank in (("lo", low), ("hi", low + 1)):
            covers = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{name}{i}"))
    found = placed.groupBy(*groups).agg(*picks)
    out = []
    for i, (name, share) in enumerate(wanted.items()):
        part = (F.lit(float(share)) * (F.col("_total") - 1)) % 1
        out.append(F.when(part > 0, F.col(f"_lo{i}") * (1 - part) + F.col(f"_hi{i}") * part).otherwise(F.col(f"_lo{i}")).alias(name))
    return found.select(*[F.col(g).alias(c) for c, g in zip(group_cols, groups)], *out)

"""Mergeable distinct counts (H2, H11 over many tables).

Each part (a source, a day, a table) keeps one HyperLogLog sketch per column, a binary of a few kilobytes that is
stored beside the data; counts over any set of parts come from merging sketches, without reading the data again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers; the standard error of a count is about 1.04 / sqrt(2^k).
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, part: Column, columns: dict[str, Column], lg_k: int = LG_K) -> DataFrame:
    """``(part, column_name, sketch, n_rows)``: one sketch per part and column, from one aggregation; nulls do not count."""
    per = df.groupBy(part.cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(c, lg_k).alias(name) for name, c in columns.items()])
    rows = [F.struct(F.lit(name).alias("column_name"), F.col(name).alias("sketch")) for name in columns]
    return per.select("part", "n_rows", F.inline(F.array(*rows)))


def merged_counts(sketches: DataFrame, keys=("column_name",)) -> DataFrame:
    """``(*keys, n_rows, n_distinct)`` over all parts of each key."""
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def exact_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(column_name, n_exact)``, one distinct aggregation per column."""
    out = None
    for name, c in columns.items():
        one = df.agg(F.count_distinct(c).alias("n_exact")).select(F.lit(name).alias("column_name"), "n_exact")
        out = one if out is None else out.unionByName(one)
    return out

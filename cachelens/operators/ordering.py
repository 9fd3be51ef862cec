"""Global order without a single-partition window.

``row_number() over (order by k)`` with no partition clause is planned by Spark as one
task holding every row, and ``partition by g`` puts a hot group in one task. Here rows are
range-partitioned on ``(g, k)`` and sorted inside each partition, so a hot group is spread
over many partitions; the per-(partition, group) row counts (a table with one row per
partition and group boundary) become offsets by prefix sums and are joined back. Only narrow keys should be
passed: the numbered rows are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.session import materialize


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in (cols or [])]


def _tagged(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n_parts, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    # The consumers below (counts and rows) must see the same partitions: the numbered rows are
    # written to the shared folder. Callers pass keys only and join wide columns back by id.
    return materialize(tagged, "ranked")


def _with_offsets(tagged: DataFrame, side: DataFrame, gnames: list[str]) -> DataFrame:
    """``side`` (one row per partition and group, null groups too) joined to its rows."""
    side = side.select(F.col("_pid").alias("_side_pid"), *[F.col(g).alias(f"_side{g}") for g in gnames],
                       *[c for c in side.columns if c != "_pid" and c not in gnames])
    same = F.col("_pid") == F.col("_side_pid")
    for g in gnames:
        same = same & F.col(g).eqNullSafe(F.col(f"_side{g}"))
    return tagged.join(side, same).drop("_side_pid", *[f"_side{g}" for g in gnames])


def dense_ids(df: DataFrame, order, out_col: str = "query_id", num_partitions: int | None = None,
              start: int = 0, partition_by=None) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order`` (a total order: end it with a unique
    id), restarting for every value of ``partition_by`` when given."""
    groups = _cols(partition_by)
    gnames = [f"_g{i}" for i in range(len(groups))]
    base = df.select("*", *[g.alias(n) for g, n in zip(groups, gnames)]) if groups else df
    tagged = _tagged(base, [F.col(n) for n in gnames] + _cols(order), num_partitions)
    counts = tagged.groupBy("_pid", *gnames).agg(F.count(F.lit(1)).alias("_n"))
    if groups:
        before_in_part = Window.partitionBy("_pid").orderBy(*gnames).rowsBetween(Window.unboundedPreceding, -1)
        before_in_group = Window.partitionBy(*gnames).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(
            "_pid", *gnames,
            F.coalesce(F.sum("_n").over(before_in_part), F.lit(0)).alias("_within"),
            F.coalesce(F.sum("_n").over(before_in_group), F.lit(0)).alias("_off"))
        joined = _with_offsets(tagged, offsets, gnames)
        value = F.col("_off") + F.col("_pos") - F.col("_within")
    else:
        w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
        joined = _with_offsets(tagged, offsets, [])
        value = F.col("_off") + F.col("_pos")
    return (joined.withColumn(out_col, (value + F.lit(start)).cast("long"))
            .drop("_pid", "_pos", "_off", "_within", *gnames))


def running_sum(df: DataFrame, order, value_col: str, out_col: str, inclusive: bool = False,
                num_partitions: int | None = None, partition_by=None, agg: str = "sum") -> DataFrame:
    """Prefix sum of ``value_col`` in ``order`` (exclusive by default), restarting per
    ``partition_by`` group, without a global or per-group window: rows are range-partitioned
    on ``(group, order)``; per-(partition, group) totals are prefix-summed on the small
    totals table and each row adds the running sum inside its own (partition, group) slice."""
    groups = _cols(partition_by)
    gnames = [f"_g{i}" for i in range(len(groups))]
    base = df.select("*", *[g.alias(n) for g, n in zip(groups, gnames)]) if groups else df
    tagged = _tagged(base, [F.col(n) for n in gnames] + _cols(order), num_partitions)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[agg]
    totals = tagged.groupBy("_pid", *gnames).agg(fn(value_col).alias("_t"))
    w = Window.partitionBy(*gnames).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *gnames, fn("_t").over(w).alias("_off"))
    end = 0 if inclusive else -1
    inner = Window.partitionBy("_pid", *gnames).orderBy("_pos").rowsBetween(Window.unboundedPreceding, end)
    if agg == "sum":
        combined = F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    else:  # nulls mean "nothing before"
        pick = F.greatest if agg == "max" else F.least
        combined = F.when(F.col("_off").isNull(), F.col("_in")).when(F.col("_in").isNull(), F.col("_off")) \
            .otherwise(pick(F.col("_off"), F.col("_in")))
    return (_with_offsets(tagged.withColumn("_in", fn(value_col).over(inner)), offsets, gnames)
            .withColumn(out_col, combined)
            .drop("_pid", "_pos", "_off", "_in", *gnames))


def previous_value(df: DataFrame, partition_by, order, value_col: str, out_col: str,
                   num_partitions: int | None = None) -> DataFrame:
    """``lag(value) over (partition by g order by o)`` that stays balanced when one group
    holds a large share of the rows: inside a range partition the lag is local; the first
    row of a group slice takes the last value of that group in the preceding partition."""
    groups = _cols(partition_by)
    gnames = [f"_g{i}" for i in range(len(groups))]
    base = df.select("*", *[g.alias(n) for g, n in zip(groups, gnames)])
    tagged = _tagged(base, [F.col(n) for n in gnames] + _cols(order), num_partitions)
    local = Window.partitionBy("_pid", *gnames).orderBy("_pos")
    lasts = tagged.groupBy("_pid", *gnames).agg(F.max_by(value_col, "_pos").alias("_last"))
    carry = Window.partitionBy(*gnames).orderBy("_pid")
    carried = lasts.select("_pid", *gnames, F.lag("_last").over(carry).alias("_carry"))
    numbered = tagged.withColumn("_lag", F.lag(value_col).over(local)).withColumn("_first", F.row_number().over(local) == 1)
    return (_with_offsets(numbered, carried, gnames)
            .withColumn(out_col, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_pid", "_pos", "_lag", "_first", "_carry", *gnames))


def sql_dense_ids(order_sql: str, partition_sql: str | None = None) -> str:
    part = f"PARTITION BY {partition_sql} " if partition_sql else ""
    return f"(row_number() OVER ({part}ORDER BY {order_sql}) - 1)"

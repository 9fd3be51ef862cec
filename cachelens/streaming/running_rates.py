"""Running hit rates of live streams (S2): checkpoints as they are passed, over any number of micro-batches.

A micro-batch numbers its rows within each stream by range partitioning and prefix sums (no task holds a
hot stream) and adds the totals of the batches before it: one row per stream and batch, in the
shared folder. A batch that runs again replaces its own rows and reads the same earlier totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators.results import stream_positions
from cachelens.session import scratch_path


def run_running_rates(stream: DataFrame, stream_col: str = "event_type", log_interval: int = 500) -> DataFrame:
    """``(<stream_col>, query_idx, cumulative_hit_rate)`` every ``log_interval`` rows of a stream and at its end, as
    ``operators.results.cumulative_hit_rate`` has it for a table. The rows (``seq, <stream_col>, hit``) arrive by
    ``seq`` from batch to batch, in any order within one."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream-running-rate")
    name = stream.schema[stream_col].dataType.simpleString()
    rates, totals = f"{stream_col} {name}, query_idx long, cumulative_hit_rate double", f"{stream_col} {name}, n long, hits long"
    for folder, schema in (("rates", rates), ("totals", totals)):
        spark.createDataFrame([], schema).write.parquet(f"{base}/{folder}/batch=-1")

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(f"{totals}, batch long").parquet(f"{base}/totals").filter(F.col("batch") < epoch) \
            .groupBy(F.col(stream_col).alias("_s")).agg(F.max("n").alias("_n"), F.max("hits").alias("_hits"))
        own = stream_positions(batch.select("seq", stream_col, "hit"), stream_col)
        placed = own.join(before, own[stream_col].eqNullSafe(F.col("_s")), "left").select(
            stream_col, (F.col("pos") + 1 + F.coalesce("_n", F.lit(0))).alias("query_idx"), (F.col("cum_hits") + F.coalesce("_hits", F.lit(0))).alias("hits"))
        last = placed.groupBy(stream_col).agg(F.max("query_idx").alias("n"), F.max("hits").alias("hits"))
        last.write.mode("overwrite").parquet(f"{base}/totals/batch={epoch}")
        passed = placed.filter(F.col("query_idx") % log_interval == 0)
        passed.select(stream_col, "query_idx", F.round(F.col("hits") / F.col("query_idx"), 6).alias("cumulative_hit_rate")) \
            .write.mode("overwrite").parquet(f"{base}/rates/batch={epoch}")

    query = (stream.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    passed = spark.read.schema(rates).parquet(f"{base}/rates").select(stream_col, "query_idx", "cumulative_hit_rate")
    ends = spark.read.schema(totals).parquet(f"{base}/totals").groupBy(stream_col).agg(F.max("n").alias("n"), F.max("hits").alias("hits"))
    ends = ends.filter(F.col("n") % log_interval != 0).select(stream_col, F.col("n").alias("query_idx"), F.round(F.col("hits") / F.col("n"), 6).alias("cumulative_hit_rate"))
    return passed.unionByName(ends)

"""Live lookups against a given cache table (S1-S3), without state of their own.

* S1 (vectors): every micro-batch is searched with the blocked vector join, exactly, and tagged
  by a distance threshold. The search picks its plan by counted sizes like any batch search.
* S3 (exact keys): a stream-static equi join.
* S2: hits and lookups per hour of the rows' own time, a streaming aggregation with a watermark.

Streams run once over what is there (``availableNow``) into the shared folder. A micro-batch
writes a folder of its own, so a repeated batch replaces its rows. Which entries the cache table
holds is the business of the retention operators; no eviction is replayed here.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.operators.vectors import lookup
from cachelens.session import scratch_path


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Parquet file stream over one table (a file or a folder) of a folder."""
    path = os.path.join(folder, f"{table}.parquet")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}*")


def _run(stream: DataFrame, name: str, mode: str, write) -> DataFrame:
    """``write(batch)`` of every micro-batch, as one table with the batch number ``batch``."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    empty = write(spark.createDataFrame([], stream.schema)).schema

    def one(batch: DataFrame, epoch: int) -> None:
        write(batch).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(one)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(empty.add("batch", "long")).option("basePath", f"{base}/out").parquet(f"{base}/out")


def tag_by_vector(stream: DataFrame, cache: DataFrame, threshold: float, *, q_id: str = "query_id", c_id: str = "cache_id",
                  vec_col: str = "embedding", exclude_self: bool = False, **strategy) -> DataFrame:
    """``(query_id, neighbor_id, dist, hit)`` of every stream row: its nearest cache entry and
    whether that lies within the threshold."""
    def tag(batch: DataFrame) -> DataFrame:
        found = lookup(batch, cache, 1, threshold, q_id=q_id, c_id=c_id, vec_col=vec_col, active_col=None, exclude_self=exclude_self, **strategy)
        return found.select("query_id", "neighbor_id", "dist", "hit")

    return _run(stream, "vectors", "append", tag).drop("batch")


def tag_by_key(stream: DataFrame, cache: DataFrame, key_col: str, time_col: str, since_col: str) -> DataFrame:
    """S3: the stream with ``hit``: its key is in the cache table and was there before the row's time."""
    entries = cache.select(F.col(key_col).alias("_key"), F.col(since_col).alias("_since"))
    joined = stream.join(entries, F.col(key_col) == F.col("_key"), "left")
    return joined.withColumn("hit", F.coalesce(F.col("_since") < F.col(time_col), F.lit(False))).drop("_key", "_since")


def hit_rate_by_hour(tagged: DataFrame, time_col: str = "ts", late: str = "2 hours") -> DataFrame:
    """``(hour, lookups, hits)`` by hours since the epoch; rows may be ``late`` by so much."""
    hour = F.window(F.col(time_col), "1 hour")
    per = tagged.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(hour.alias("w")).agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))
    return per.select((F.unix_seconds(F.col("w.start")) / 3600).cast("long").alias("hour"), "lookups", "hits")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The rows of an append-mode stream."""
    return _run(stream, name, "append", lambda batch: batch).drop("batch")


def run_updates_to_table(stream: DataFrame, name: str, key_cols: list[str]) -> DataFrame:
    """The last state of an update-mode aggregate of numbers: the latest row of each key."""
    rows = _run(stream, name, "update", lambda batch: batch)
    values = [c for c in rows.columns if c not in (*key_cols, "batch")]
    return rows.groupBy(*key_cols).agg(*[F.max_by(c, "batch").alias(c) for c in values])

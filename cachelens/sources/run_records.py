"""Run records (A7): JSON documents of retention runs, nested policy -> cache size -> list of runs.

``{"config": ..., "per_seed": {policy: {"0.10": [run, ...]}}}``, where a run has its seed, workload,
final rates, timing, cache counts, and its checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = ("struct<seed:bigint,workload:string,gamma:double,final_hit_rate:double,semantic_coverage_avg_dist:double,diversity:double,"
       "timing:struct<stream_time_s:double>,cache_stats:struct<n_evictions:bigint>,"
       "cumulative_hit_rates:array<struct<query_idx:bigint,cumulative_hit_rate:double,rolling_hit_rate:double,evictions:bigint>>>")
DOCUMENT = T.StructType.fromDDL(f"per_seed map<string,map<string,array<{RUN}>>>")


def scan_run_records(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """One row per run: ``policy, cache_size_pct, seed, workload, gamma, final_hit_rate,
    semantic_coverage_avg_dist, diversity, stream_time_s, n_evictions, checkpoints``. A file is
    one document, or with ``lines`` one document a line."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", not lines).json(paths)
    runs = (docs.select(F.explode("per_seed").alias("policy", "sizes"))
            .select("policy", F.explode("sizes").alias("size", "runs"))
            .select("policy", F.col("size").cast("double").alias("cache_size_pct"), F.explode("runs").alias("r")))
    return runs.select("policy", "cache_size_pct", "r.seed", "r.workload", "r.gamma", "r.final_hit_rate", "r.semantic_coverage_avg_dist",
                       "r.diversity", "r.timing.stream_time_s", "r.cache_stats.n_evictions",
                       F.col("r.cumulative_hit_rates").alias("checkpoints"))


def write_run_records(runs: DataFrame, folder: str) -> str:
    """One document per policy and cache size, in a folder of JSON lines; the runs of one cell
    of an experiment (its seeds) are a short list."""
    run = F.struct("seed", "workload", "gamma", "final_hit_rate", "semantic_coverage_avg_dist", "diversity",
                   F.struct("stream_time_s").alias("timing"), F.struct("n_evictions").alias("cache_stats"),
                   *([F.col("checkpoints").alias("cumulative_hit_rates")] if "checkpoints" in runs.columns else []))
    cells = runs.groupBy("policy", F.format_number("cache_size_pct", 2).alias("size")).agg(F.collect_list(run).alias("runs"))
    cells.select(F.create_map("policy", F.create_map("size", "runs")).alias("per_seed")).write.mode("overwrite").json(folder)
    return folder


def checkpoint_rows(runs: DataFrame) -> DataFrame:
    """The checkpoints of every run as rows."""
    return runs.select("policy", "cache_size_pct", "seed", "workload", F.inline("checkpoints"))

"""Scans and sinks (A1-A7): typed parquet scans, nested conversations, parquet/JSON sinks
and the reader for benchmark-result JSON files in their three layouts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

EMBEDDING_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])

RUN_STRUCT = T.StructType([
    T.StructField("index_type", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("dataset_size", T.LongType()),
    T.StructField("dataset_label", T.StringType()),
    T.StructField("workload", T.StringType()),
    T.StructField("recall_at_1", T.DoubleType()),
    T.StructField("recall_at_5", T.DoubleType()),
    T.StructField("recall_at_10", T.DoubleType()),
    T.StructField("search_latency_ms", T.StructType([T.StructField("p50", T.DoubleType())])),
    T.StructField("build_time_s", T.DoubleType()),
    T.StructField("memory_mb", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


# ------------------------------------------------------------------------------ A1

def scan_queries(spark: SparkSession, path: str, schema: T.StructType = QUERY_SCHEMA) -> DataFrame:
    """Typed parquet scan (no inference; column pruning and filters reach the reader)."""
    return spark.read.schema(schema).parquet(path)


# ------------------------------------------------------------------------------ A2

def scan_conversations(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Flat turns; ``streaming=True`` gives a file-stream source over the same folder."""
    if streaming:
        return spark.readStream.schema(CONVERSATION_SCHEMA).parquet(path)
    return spark.read.schema(CONVERSATION_SCHEMA).parquet(path)


def nest_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation with ``conversation ARRAY<STRUCT<turn, role, content>>`` in turn order.

    ``collect_list`` is bounded by the length of one conversation."""
    return turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))))
        .alias("conversation"))


# ------------------------------------------------------------------------------ A3, A6

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Overwrite sink; the parent folder is created by the writer; no index column."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)
    return path


def write_results_json(df: DataFrame, path: str) -> str:
    """Nested JSON result sink (structs and arrays kept)."""
    return write_table(df, path, "json")


# ------------------------------------------------------------------------------ A4

def embedding_table(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Read vectors and check ``ARRAY<FLOAT>`` and (optionally) the expected dimension."""
    df = spark.read.parquet(path)
    et = df.schema["embedding"].dataType
    if not (isinstance(et, T.ArrayType) and isinstance(et.elementType, T.FloatType)):
        raise TypeError(f"embedding must be ARRAY<FLOAT>, got {et.simpleString()}")
    if dim is not None:
        bad = df.filter(F.size("embedding") != dim).limit(1).count()
        if bad:
            raise ValueError(f"embedding dimension differs from {dim}")
    return df


# ------------------------------------------------------------------------------ A7

def write_benchmark_files(runs: DataFrame, folder: str) -> list[str]:
    """Write one result document per dataset label, rotating the three layouts
    (flat list, ``{"results": [...]}``, ``{"runs": [...]}``). A result table has one row per
    configuration, so one document per label is a bounded aggregate."""
    runs = runs.select(*[F.col(f.name) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_STRUCT.fields])
    labels = sorted(r[0] for r in runs.select("dataset_label").distinct().collect())
    paths = []
    for i, label in enumerate(labels):
        rows = runs.filter(F.col("dataset_label") == label)
        lst = F.collect_list(F.struct(*[F.col(f.name) for f in RUN_STRUCT.fields]))
        if i % 3 == 0:
            doc = rows.agg(F.to_json(lst).alias("value"))
        else:
            key = "results" if i % 3 == 1 else "runs"
            doc = rows.agg(F.to_json(F.struct(lst.alias(key))).alias("value"))
        path = os.path.join(folder, f"index_benchmark_{label}.json")
        doc.coalesce(1).write.mode("overwrite").text(path)
        paths.append(path)
    return paths


def scan_benchmark_results(spark: SparkSession, glob: str) -> DataFrame:
    """Every ``index_benchmark_*.json``; the scale label comes from the file name; flat list,
    ``{results}`` and ``{runs}`` are accepted; rows with ``error`` are dropped."""
    wrapped = T.StructType(RUN_STRUCT.fields + [
        T.StructField("results", T.ArrayType(RUN_STRUCT)), T.StructField("runs", T.ArrayType(RUN_STRUCT))])
    raw = spark.read.schema(wrapped).option("multiLine", True).json(glob) \
        .withColumn("file_label", F.regexp_extract(F.col("_metadata.file_path"), r"index_benchmark_([^/]+?)\.json", 1))
    flat = raw.filter(F.col("index_type").isNotNull()).select("file_label", *[f.name for f in RUN_STRUCT.fields])
    nested = raw.filter(F.col("index_type").isNull()) \
        .select("file_label", F.explode(F.coalesce("runs", "results")).alias("r")).select("file_label", "r.*")
    return flat.unionByName(nested).filter(F.col("error").isNull()) \
        .withColumn("dataset_label", F.col("file_label")) \
        .withColumn("search_p50_ms", F.col("search_latency_ms.p50")).drop("file_label", "search_latency_ms")

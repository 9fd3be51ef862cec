"""Session, table loading and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cachelens") -> SparkSession:
    """Local session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage, as the session names it.

    Read from the checkpoint folder already set or ``spark.checkpoint.dir``. Where neither is
    set, a local session (tests, bench) gets a scratch folder of its own; a cluster has no
    folder that this code could choose, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="cachelens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``drop_scratch`` removes what was written there."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove the given scratch tables, or all of this process. Results not yet collected that
    read them are lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or tuple(_scratch):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _scratch.remove(path)


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Cut lineage of a result that is reused by several later steps (a built index, a
    ground-truth kNN table): it is written once as parquet into the shared checkpoint
    folder and read back, so a lost executor never forces recomputation of the expensive
    part, and later scans get column pruning and statistics. ``partition_by`` lets a scan of one
    value of that column read its rows only; ``compression`` names another codec than the session's."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))

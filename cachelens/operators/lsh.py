"""Banded LSH search and stored code tables (E4 at scale; E6, E7, E9 for code tables).

A code of ``nbits`` sign bits is cut into bands. A row is filed once per band under (band, bits of the
band); a query asks for the bits of its own bands and, with ``radius`` 1, for those with one bit
flipped. What meets there is compared by the Hamming distance of the whole codes, so the only rows
missed are those that differ from the query by more than ``radius`` bits in every band.

Queries and rows meet by an equi key and are compared in blocks (``TopK``): a bucket gives at most k rows
per query, never its pairs. A bucket of more than ``rows_per_block`` rows is split by a hash of the id
and its queries are repeated for each part; only such buckets are listed, so the list has at
most bands * rows / rows_per_block entries.

``LSHTable`` keeps the filed codes as a table bucketed by that key: a search shuffles the
queries and reads the stored side in place.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.operators.ann import lsh_codes, lsh_hyperplanes
from cachelens.operators.vector_join import DEFAULT_ROWS_PER_BLOCK, TopK, _run_kernel, arrow_vectors
from cachelens.session import materialize

FILED = "key long, part int, id long, code array<bigint>"


def band_width(nbits: int, bands: int) -> int:
    width = nbits // bands
    if width * bands != nbits or not 1 <= width <= 24 or 64 % width:
        raise ValueError(f"{bands} bands do not cut {nbits} bits into equal bands within 64-bit words")
    return width


def band_keys(codes: DataFrame, nbits: int, bands: int, radius: int = 0) -> DataFrame:
    """``key, id, code`` of ``(id, code)``: the key of every band, and of its neighbours by one bit."""
    if radius not in (0, 1):
        raise ValueError("radius is 0 or 1")
    width = band_width(nbits, bands)
    flips = np.array([0] + [1 << j for j in range(width)] * radius, np.int64)

    def run(batches):
        for b in batches:
            ids, code = arrow_vectors(b, "id", "code", np.int64)
            if not len(ids):
                continue
            at = np.arange(bands) * width
            value = (code.view(np.uint64)[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64((1 << width) - 1)
            keys = ((np.arange(bands) << 32) | value.astype(np.int64))[:, :, None] ^ flips
            row = pa.array(np.repeat(np.arange(len(ids)), bands * len(flips)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids).take(row), b.column(1).take(row)], ["key", "id", "code"])

    return codes.filter("code IS NOT NULL").mapInArrow(run, "key long, id long, code array<bigint>")


def hot_buckets(filed: DataFrame, rows_per_block: int) -> DataFrame:
    """``key, parts`` of the buckets that are split."""
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_block)
    return sizes.select("key", F.ceil(F.col("n") / rows_per_block).cast("int").alias("parts"))


def file_rows(codes: DataFrame, nbits: int, bands: int, hot: DataFrame) -> DataFrame:
    """``FILED`` rows of ``(id, code)``."""
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
    return band_keys(codes, nbits, bands).join(hot, "key", "left").select("key", part.alias("part"), "id", "code")


def search_filed(asked: DataFrame, filed: DataFrame, hot: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, neighbor_id, hamming)`` of the ``band_keys`` rows ``asked`` in ``FILED`` rows."""
    probes = asked.join(hot, "key", "left") \
        .select("key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("id").alias("_qid"), F.col("code").alias("_qv"))
    kernel = TopK(k=k, metric="hamming")

    def bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, Q = arrow_vectors(left, "_qid", "_qv", np.int64)
        ids, X = arrow_vectors(right, "id", "code", np.int64)
        return _run_kernel(kernel, qids, Q, [(ids, X)])

    met = probes.groupBy("key", "part").cogroup(filed.groupBy("key", "part")).applyInArrow(bucket, kernel.schema())
    once = met.groupBy("query_id", "neighbor_id").agg(F.min("hamming").alias("hamming"))  # found in several bands
    order = Window.partitionBy("query_id").orderBy("hamming", "neighbor_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "hamming")


def _codes(df: DataFrame, planes: np.ndarray, id_col: str, vec_col: str) -> DataFrame:
    return lsh_codes(df.filter(F.col(vec_col).isNotNull()), planes, id_col, vec_col).select(F.col(id_col).alias("id"), "code")


def knn_lsh_banded(queries: DataFrame, database: DataFrame, k: int, nbits: int = 128, bands: int = 16, radius: int = 1, seed: int = 42, *,
                   q_id: str = "query_id", d_id: str = "id", vec_col: str = "embedding",
                   rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Hamming top-k among the rows that share a band with the query (up to ``radius`` bits)."""
    first = database.filter(F.col(vec_col).isNotNull()).select(vec_col).first()
    if first is None:
        return database.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, hamming double")
    planes = lsh_hyperplanes(nbits, len(first[0]), seed)
    codes = materialize(_codes(database, planes, d_id, vec_col), "codes")
    hot = hot_buckets(band_keys(codes, nbits, bands), rows_per_block)
    return search_filed(band_keys(_codes(queries, planes, q_id, vec_col), nbits, bands, radius), file_rows(codes, nbits, bands, hot), hot, k)


class LSHTable:
    """Filed codes in a bucketed table, its hyperplanes and its list of split buckets, in one folder.

    ``append`` files new rows beside the old ones. ``remove`` adds ids to a list that searches leave out
    (broadcast while it is under ``MAX_REMOVED`` ids; ``compact`` rewrites the table without them)."""

    MAX_REMOVED = 1_000_000

    def __init__(self, spark: SparkSession, path: str, nbits: int, bands: int, planes: np.ndarray, buckets: int):
        self.spark, self.path, self.nbits, self.bands, self.planes, self.buckets = spark, path, nbits, bands, planes, buckets
        self.name = f"codes_{uuid.uuid4().hex[:12]}"
        self._register()

    @staticmethod
    def save(database: DataFrame, path: str, nbits: int = 128, bands: int = 16, seed: int = 42, id_col: str = "id", vec_col: str = "embedding",
             buckets: int | None = None, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> "LSHTable":
        """Files the rows of ``database`` under ``path``."""
        spark = database.sparkSession
        dim = len(database.filter(F.col(vec_col).isNotNull()).select(vec_col).first()[0])
        planes = lsh_hyperplanes(nbits, dim, seed)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = [(i, [float(x) for x in p]) for i, p in enumerate(planes)]
        spark.createDataFrame(rows, "plane int, normal array<double>").coalesce(1).write.parquet(os.path.join(path, "planes"))
        spark.createDataFrame([(nbits, bands, buckets)], "nbits int, bands int, buckets int").coalesce(1).write.parquet(os.path.join(path, "form"))
        codes = materialize(_codes(database, planes, id_col, vec_col), "codes")
        hot = hot_buckets(band_keys(codes, nbits, bands), rows_per_block)
        hot.write.parquet(os.path.join(path, "hot"))
        spark.createDataFrame([], "id long").write.parquet(os.path.join(path, "removed"))
        table = LSHTable.load(spark, path)
        table._file(codes)
        return table

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LSHTable":
        form = spark.read.parquet(os.path.join(path, "form")).first()
        planes = spark.read.parquet(os.path.join(path, "planes")).orderBy("plane").collect()  # nbits rows
        return LSHTable(spark, path, form["nbits"], form["bands"], np.array([p["normal"] for p in planes]), form["buckets"])

    def _register(self) -> None:
        self.spark.sql(f"CREATE TABLE {self.name} ({FILED.replace(' long', ' bigint')}) USING parquet "
                       f"CLUSTERED BY (key, part) INTO {self.buckets} BUCKETS LOCATION '{os.path.join(self.path, 'codes')}'")

    def drop(self) -> None:
        """Forgets the catalogue entry; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    @property
    def hot(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, "hot"))

    @property
    def removed(self) -> DataFrame:
        return self.spark.read.schema("id long").parquet(os.path.join(self.path, "removed"))

    @property
    def filed(self) -> DataFrame:
        return self.spark.table(self.name)

    def _file(self, codes: DataFrame) -> None:
        filed = file_rows(codes, self.nbits, self.bands, self.hot).repartition(self.buckets, "key", "part")  # one file a bucket
        filed.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> "LSHTable":
        self._file(_codes(rows, self.planes, id_col, vec_col))
        return self

    def remove(self, ids: DataFrame, id_col: str = "id") -> "LSHTable":
        ids.select(F.col(id_col).cast("long").alias("id")).write.mode("append").parquet(os.path.join(self.path, "removed"))
        return self

    def alive(self) -> DataFrame:
        gone = self.removed
        n = gone.count()
        if not n:
            return self.filed
        return self.filed.join(F.broadcast(gone) if n <= self.MAX_REMOVED else gone, "id", "left_anti").select("key", "part", "id", "code")

    def compact(self, path: str) -> "LSHTable":
        """The rows that are left, filed anew under another folder."""
        codes = materialize(self.alive().filter(F.shiftright("key", 32) == 0).select("id", "code"), "codes")
        for part in ("planes", "form", "hot"):
            self.spark.read.parquet(os.path.join(self.path, part)).write.parquet(os.path.join(path, part))
        self.spark.createDataFrame([], "id long").write.parquet(os.path.join(path, "removed"))
        table = LSHTable.load(self.spark, path)
        table._file(codes)
        return table

    def search(self, queries: DataFrame, k: int, radius: int = 1, q_id: str = "query_id", vec_col: str = "embedding") -> DataFrame:
        asked = band_keys(_codes(queries, self.planes, q_id, vec_col), self.nbits, self.bands, radius)
        return search_filed(asked, self.alive(), self.hot, k)

"""Approximate nearest-neighbour search as Spark jobs.

* LSH (E4): sign of random projections on seeded Gaussian hyperplanes, packed into 64-bit
  words (``ARRAY<BIGINT>``); search is an exhaustive Hamming top-k with the blocked join.
  The hyperplanes depend only on (seed, plane, dim), so SQL can rebuild them.
* IVF (E3): mini-batch k-means centres, every row tagged with its nearest cell; a
  query scans its ``nprobe`` nearest cells. Query and database rows meet by an equi-key
  on the cell (co-grouped), and a cell bigger than ``rows_per_block`` is split into
  sub-blocks with the probing queries replicated to each, so a hot cell never lands in
  one task.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.draws import DRAW_DIGITS, md5_order_key, uniform_draw
from cachelens.operators.vector_join import (DEFAULT_ROWS_PER_BLOCK, TopK, _run_kernel, arrow_vectors,
                                             knn)
from cachelens.operators.vectors import assign_nearest, row_slices
from cachelens.session import checkpoint_dir


# ------------------------------------------------------------------------------ E4 LSH

def lsh_hyperplanes(nbits: int, dim: int, seed: int = 42) -> np.ndarray:
    """Gaussian hyperplanes by Box-Muller over md5 draws of ``seed:lsh_a|lsh_b:(plane*dim+i)``."""
    n = nbits * dim
    u = np.empty((2, n))
    for r, salt in enumerate(("lsh_a", "lsh_b")):
        for idx in range(n):
            h = hashlib.md5(f"{seed}:{salt}:{idx}".encode()).hexdigest()
            u[r, idx] = int(h[:DRAW_DIGITS], 16) / 16.0**DRAW_DIGITS
    z = np.sqrt(-2.0 * np.log(1.0 - u[0])) * np.cos(2.0 * math.pi * u[1])
    return z.reshape(nbits, dim)


def lsh_codes(df: DataFrame, planes: np.ndarray, id_col: str = "id", vec_col: str = "embedding",
              out_col: str = "code") -> DataFrame:
    """``(<id_col>, code ARRAY<BIGINT>)``: bit j of word w is ``x . plane[64w + j] > 0``."""
    spark = df.sparkSession
    H = np.asarray(planes, dtype=np.float64)
    nbits = H.shape[0]
    words = (nbits + 63) // 64
    bc = spark.sparkContext.broadcast(H)

    def scan(batches):
        Hm = bc.value
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))
        for b in batches:
            ids, X = arrow_vectors(b, id_col, vec_col)
            if len(ids) == 0:
                continue
            codes = np.empty((len(ids), words), np.int64)
            for at in row_slices(len(ids), words * 64):
                pad = np.zeros((len(ids[at]), words * 64), dtype=bool)
                pad[:, :nbits] = (X[at] @ Hm.T) > 0
                packed = (pad.reshape(len(pad), words, 64).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
                codes[at] = packed.view(np.int64)
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(ids, pa.int64()),
                out_col: pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1), pa.int64()), words)
                .cast(pa.list_(pa.int64())),
            })

    return df.select(F.col(id_col).cast("long").alias(id_col), vec_col) \
        .mapInArrow(scan, f"{id_col} long, {out_col} array<bigint>")


def knn_lsh(queries: DataFrame, database: DataFrame, k: int, nbits: int = 64, seed: int = 42, *,
            q_id: str = "query_id", d_id: str = "id", vec_col: str = "embedding", **strategy) -> DataFrame:
    """Hamming top-k over LSH codes: ``(query_id, rank, neighbor_id, hamming)``."""
    dim = len(database.select(vec_col).first()[0])
    H = lsh_hyperplanes(nbits, dim, seed)
    qc = lsh_codes(queries, H, q_id, vec_col)
    dc = lsh_codes(database, H, d_id, vec_col)
    return knn(qc, dc, k, metric="hamming", q_id=q_id, q_vec="code", d_id=d_id, d_vec="code", **strategy)


# ------------------------------------------------------------------------------ E8 k-means

KMEANS_BATCHES, KMEANS_EPOCHS = 4, 2


def batch_sums(rows: DataFrame, centers: np.ndarray, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum vector) by nearest centre: one short row per centre leaves a task, k * dim numbers the job."""
    bc = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))

    def scan(batches):
        C = bc.value
        cn = np.einsum("ij,ij->i", C, C)
        n, s = np.zeros(len(C), np.int64), np.zeros(C.shape)
        for b in batches:
            ids, X = arrow_vectors(b, id_col, vec_col)
            for at in row_slices(len(ids), len(C)):
                part = X[at]
                cell = (cn[None, :] - 2.0 * (part @ C.T)).argmin(axis=1)  # ties: lower centre
                n += np.bincount(cell, minlength=len(C))
                np.add.at(s, cell, part)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int32()), "n": pa.array(n[own], pa.int64()), "s": pa.array(list(s[own]), pa.list_(pa.float64()))})

    parts = rows.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(scan, "cell int, n long, s array<double>")
    sums = parts.select("cell", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s")).alias("i", "x")) \
        .groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()  # k * (dim + 1) numbers
    out = np.zeros((len(centers), np.asarray(centers).shape[1] + 1))
    out[sums.column("cell").to_numpy(), sums.column("i").to_numpy()] = sums.column("x").to_numpy()
    return out[:, 0], out[:, 1:]


def kmeans_centers(df: DataFrame, k: int, seed: int = 42, vec_col: str = "embedding", id_col: str = "id",
                   batches: int = KMEANS_BATCHES, epochs: int = KMEANS_EPOCHS) -> np.ndarray:
    """Mini-batch k-means (E8): the centres (k x dim, an index parameter).

    The first centres are the first ``k`` rows in md5 order. Every row belongs to one of ``batches`` md5
    batches; a batch's rows are summed by nearest centre where they lie, and a centre moves to the mean of all
    rows it was given so far. Each of the batches * epochs steps is one job over its own batch, which
    is written apart once, so nothing is cached and a lost task repeats its part of one step."""
    from cachelens.session import materialize

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).filter("_v IS NOT NULL")
    first = rows.orderBy(md5_order_key(seed, "kmeans_init", "_id"), "_id").limit(k)
    # collected in order: k rows
    centers = np.array([r["_v"] for r in first.collect()], dtype=np.float64)
    if len(centers) < k:
        raise ValueError(f"{k} centres asked of {len(centers)} rows")
    batch = F.floor(uniform_draw(seed, "kmeans_batch", "_id") * batches).cast("int")
    tables = [rows.filter(batch == t) for t in range(batches)]
    if epochs > 1:
        written = materialize(rows.withColumn("_batch", batch), "batches", partition_by="_batch")
        tables = [written.filter(F.col("_batch") == t).drop("_batch") for t in range(batches)]
    seen = np.zeros(k)
    for step in range(batches * epochs):
        n, s = batch_sums(tables[step % batches], centers, "_id", "_v")
        seen += n
        hit = n > 0
        centers[hit] += (s[hit] - n[hit, None] * centers[hit]) / seen[hit, None]
    return centers


def kmeans_assign(df: DataFrame, centers: np.ndarray, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Nearest centre per row (also for rows not used in training)."""
    return assign_nearest(df, centers, id_col, vec_col, k=1).select(id_col, "cell", "dist")


# ------------------------------------------------------------------------------ E3 IVF

class IVFIndex:
    """Inverted-file index over a vector table: centres + the table tagged with ``cell``."""

    def __init__(self, centers: np.ndarray, table: DataFrame, id_col: str, vec_col: str = "embedding"):
        self.centers, self.table, self.id_col, self.vec_col = centers, table, id_col, vec_col

    @classmethod
    def build(cls, database: DataFrame, nlist: int, seed: int = 42, id_col: str = "id",
              vec_col: str = "embedding", centers: np.ndarray | None = None) -> "IVFIndex":
        """Mini-batch k-means over all rows, or the given ``centers`` (``nlist``
        of them). More cells than rows is an error."""
        from cachelens.session import materialize

        n = database.count()
        if nlist > n:
            raise ValueError(f"nlist = {nlist} exceeds the {n} rows of the database")
        if centers is None:
            centers = kmeans_centers(database, nlist, seed, vec_col, id_col)
        elif len(centers) != nlist:
            raise ValueError(f"{len(centers)} centers given for nlist = {nlist}")
        tagged = assign_nearest(database, centers, id_col, vec_col, k=1, keep_vector=True) \
            .select(id_col, vec_col, "cell")
        # the built index is a table: lineage cut in the shared checkpoint folder
        return cls(centers, materialize(tagged), id_col, vec_col)

    def add(self, rows: DataFrame) -> "IVFIndex":
        """New rows get their cell from the same centres."""
        new = assign_nearest(rows, self.centers, self.id_col, self.vec_col, k=1, keep_vector=True) \
            .select(self.id_col, self.vec_col, "cell")
        return IVFIndex(self.centers, self.table.unionByName(new), self.id_col, self.vec_col)

    def remove(self, ids: DataFrame) -> "IVFIndex":
        """Anti join by id."""
        return IVFIndex(self.centers, self.table.join(ids.select(self.id_col), self.id_col, "left_anti"),
                        self.id_col, self.vec_col)

    def save(self, path: str) -> None:
        """The table partitioned by cell (cells become directories: partition pruning)
        plus the centre table."""
        self.table.write.mode("overwrite").partitionBy("cell").parquet(os.path.join(path, "table"))
        spark = self.table.sparkSession
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "centers"))

    @classmethod
    def load(cls, spark, path: str, id_col: str, vec_col: str = "embedding") -> "IVFIndex":
        c = spark.read.parquet(os.path.join(path, "centers")).orderBy("cell").collect()  # nlist rows
        centers = np.array([r["centroid"] for r in c], dtype=np.float64)
        table = spark.read.parquet(os.path.join(path, "table"))
        return cls(centers, table, id_col, vec_col)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, q_id: str = "query_id",
               rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
        """``(query_id, rank, neighbor_id, dist)`` over the ``nprobe`` nearest cells."""
        return self.search_probes(queries, k, [nprobe], q_id, rows_per_block).drop("nprobe")

    def search_probes(self, queries: DataFrame, k: int, nprobes: list[int], q_id: str = "query_id",
                      rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
        """``(nprobe, query_id, rank, neighbor_id, dist)`` for several numbers of probed cells: each cell is
        searched once, and a smaller number takes the lists of its nearer cells."""
        wanted = sorted(set(nprobes))
        top = max(1, min(wanted[-1], len(self.centers)))
        probes = assign_nearest(queries, self.centers, q_id, self.vec_col, k=top, keep_vector=True) \
            .select(F.col(q_id).alias("_qid"), "cell", F.col(self.vec_col).alias("_qv"), F.col("rank").alias("_place"))
        sizes = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")) \
            .withColumn("_subs", F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_block)).cast("int"))
        # one row per cell: bounded by nlist
        sizes = F.broadcast(sizes.select("cell", "_subs"))
        qside = (probes.join(sizes, "cell")
                 .withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)))
                 .select("cell", "_sub", "_qid", "_qv", "_place"))
        # only probed cells are read: the probed set (at most nlist values) becomes a partition
        # filter, so on a table saved with partitionBy("cell") unprobed cells are never scanned
        probed = [r[0] for r in probes.select("cell").distinct().collect()]
        dside = (self.table.filter(F.col("cell").isin(probed)).join(sizes, "cell")
                 .withColumn("_sub", F.pmod(F.xxhash64(self.id_col), F.col("_subs")).cast("int"))
                 .select("cell", "_sub", F.col(self.id_col).cast("long").alias("_did"),
                         F.col(self.vec_col).alias("_dv")))
        kern = TopK(k=k)

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, Q = arrow_vectors(left, "_qid", "_qv")
            xids, X = arrow_vectors(right, "_did", "_dv")
            found = _run_kernel(kern, qids, Q, [(xids, X)])
            place = dict(zip(left.column("_qid").to_pylist(), left.column("_place").to_pylist()))  # a query asks a cell once
            return found.append_column("place", pa.array([place[q] for q in found.column("query_id").to_pylist()], pa.int32()))

        part = (qside.groupBy("cell", "_sub").cogroup(dside.groupBy("cell", "_sub"))
                .applyInArrow(cell, f"{kern.schema()}, place int"))
        if len(wanted) > 1:
            takes = F.filter(F.array(*[F.lit(n) for n in wanted]), lambda n: n >= F.col("place"))
            part = part.withColumn("nprobe", F.explode(takes))
        else:
            part = part.withColumn("nprobe", F.lit(wanted[0]))
        w = Window.partitionBy("nprobe", "query_id").orderBy("dist", "neighbor_id")
        return (part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("nprobe", "query_id", "rank", "neighbor_id", "dist"))


def roundtrip_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------------------------ E5

INDEX_TYPES = ("flat", "ivf", "lsh")


def list_index_types() -> list[str]:
    return list(INDEX_TYPES)


def knn_index(index_type: str, queries: DataFrame, database: DataFrame, k: int, *, q_id: str = "query_id",
              d_id: str = "id", vec_col: str = "embedding", **params) -> DataFrame:
    """One entry point: ``flat`` (exact), ``ivf`` (nlist, nprobe, seed, centers) or ``lsh`` (nbits, seed)."""
    kind = index_type.strip().lower()
    if kind == "flat":
        return knn(queries, database, k, metric=params.get("metric", "l2"), q_id=q_id, q_vec=vec_col,
                   d_id=d_id, d_vec=vec_col)
    if kind == "ivf":
        idx = IVFIndex.build(database, params.get("nlist", 100), params.get("seed", 42), d_id, vec_col,
                             centers=params.get("centers"))
        return idx.search(queries, k, params.get("nprobe", 10), q_id=q_id)
    if kind == "lsh":
        return knn_lsh(queries, database, k, params.get("nbits", 64), params.get("seed", 42),
                       q_id=q_id, d_id=d_id, vec_col=vec_col)
    raise ValueError(f"unknown index type {index_type!r}; available: {', '.join(INDEX_TYPES)}")

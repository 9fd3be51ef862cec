"""Approximate nearest neighbours by inner product: lists of rotated vectors, scanned by columns.

Centres are fitted (k-means) on a documented sample of a quarter of the vectors, ``SAMPLE`` at most (``SAMPLE_BYTES`` bytes); every vector
is filed under its nearest centre. Inside a list the vectors are turned by one random rotation
and scanned in blocks of columns. After ``d`` of ``D`` columns the squared distance so far,
times ``D / d``, estimates the whole one; a candidate whose estimate is beyond the radius of the
k-th best by more than chance allows (factor ``1 + EPSILON / sqrt(d)``) is left. The radius of a
candidate comes from the k-th best inner product: ``|q|^2 + |x|^2 - 2 t``. Survivors are scored
exactly, in double precision, on the original vectors.

The search of a list does not start blind: the k-th best inner product of a query within the
sample rows of its lists is a lower bound of its k-th best there, so only candidates that may
reach it leave a list, few for each query whatever the number of lists. Sample rows are never
left by chance, so every query gets k.

How many lists a query probes is calibrated on the sample: the smallest number that holds
``coverage`` of the true neighbours of up to ``CALIBRATION`` sample vectors. Lists and queries
are dealt in cells of bounded size, so a list of any size (one very common vector) is split.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those whose length differs from the most common one; a null id is never a query
and as a candidate comes last among ties; a query id given more than once searches with its
smallest vector; rows that repeat an id are candidates each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.llm.common import map_batches, materialize

SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
CALIBRATION = 256
LIST_ROWS, MAX_LISTS = 2_000, 4_096
CELL_ROWS, CELL_QUERIES = 8_192, 20_000
BLOCK = 16
EPSILON = 2.1
LAST_ID = 2**63 - 1


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centres(sample: np.ndarray, n_lists: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """k-means centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each vector, nearest first."""
    closeness = vectors @ centres.T - 0.5 * (centres**2).sum(axis=1)
    return np.argsort(-closeness, axis=1, kind="stable")[:, :n]


def calibrate(sample: np.ndarray, centres: np.ndarray, k: int, coverage: float) -> int:
    """Lists to probe so that they hold ``coverage`` of the sample's true neighbours."""
    step = max(1, len(sample) // CALIBRATION)
    probes = np.arange(0, len(sample), step)
    near = sample[probes] @ sample.T
    near[np.arange(len(probes)), probes] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    own = nearest_lists(sample, centres, 1)[:, 0]
    place = np.argsort(nearest_lists(sample[probes], centres, len(centres)), axis=1)  # rank of each list
    ranks = np.take_along_axis(place, own[best], axis=1).ravel()
    held = np.cumsum(np.bincount(ranks, minlength=len(centres))) / max(1, len(ranks))
    return int(np.searchsorted(held, coverage)) + 1 if len(ranks) else len(centres)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def sample_bounds(query_ids: np.ndarray, queries: np.ndarray, probed: np.ndarray, ids: np.ndarray, sample: np.ndarray, lists: np.ndarray,
                  k: int) -> np.ndarray:
    """A lower bound of each query's k-th best inner product in its probed lists, from the sample's
    other rows in these lists (``lists``: the list of each sample row)."""
    if len(ids) <= k:
        return np.full(len(queries), -np.inf)
    near = queries @ sample.T
    reached = np.zeros((len(queries), max(lists.max(), probed.max()) + 1), bool)
    np.put_along_axis(reached, probed, True, axis=1)
    near[~reached[:, lists] | (query_ids[:, None] == ids)] = -np.inf
    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    return least - 1e-9 * (1 + np.abs(least))  # both sums may differ in their last bits


def scan(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, drawn: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the ``k`` best found for each query in one list, as
    far as they score ``least`` or more. ``drawn`` rows (of the sample) are scored without a test."""
    dim = vectors.shape[1]
    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    turn = rotation(dim)
    turned_q, turned_x = queries @ turn, vectors @ turn
    norm_q, norm_x = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    best_q, best_id, best_score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    blocks = [slice(at, min(at + BLOCK, dim)) for at in range(0, dim, BLOCK)]
    squares_q, squares_x = ([(t[:, at] ** 2).sum(axis=1) for at in blocks] for t in (turned_q, turned_x))
    bound = least.copy()
    done = 0
    for size in (min(256, len(ids)), *[1024] * -(-max(0, len(ids) - 256) // 1024)):
        rows = np.arange(done, min(done + size, len(ids)))
        done = rows[-1] + 1
        own, rows = rows[drawn[rows]], rows[~drawn[rows]]
        own_q, own_x = np.nonzero(queries @ vectors[own].T >= bound[:, None] - 1e-9)
        radius = norm_q[:, None] + norm_x[rows] - 2 * bound[:, None]
        part, pairs = np.zeros(radius.shape), None
        for at, sq, sx in zip(blocks, squares_q, squares_x, strict=True):
            seen = at.stop
            limit = (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else 1.0
            if pairs is None:  # most pairs are left: all of them by a product of the block's columns
                step = turned_q[:, at] @ (-2 * turned_x[rows, at]).T
                step += sx[rows]
                step += sq[:, None]
                part += step
                near = part <= radius * limit + 1e-9
                if seen == dim or near.mean() < 0.05:
                    pairs = q, x = np.nonzero(near)
                    part, radius, x = part[q, x], radius[q, x], rows[x]
            else:
                part = part + ((turned_q[q, at] - turned_x[x, at]) ** 2).sum(axis=1)
                near = part <= radius * limit + 1e-9
                q, x, part, radius = q[near], x[near], part[near], radius[near]
        q, x = np.r_[q, own_q], np.r_[x, own[own_x]]
        other = ids[x] != query_ids[q]
        q, x = q[other], x[other]
        score = (queries[q] * vectors[x]).sum(axis=1)
        high = score >= bound[q]
        q, x, score = q[high], x[high], score[high]
        best_q, best_id, best_score = np.r_[best_q, q], np.r_[best_id, ids[x]], np.r_[best_score, score]
        order = np.lexsort((best_id, -best_score, best_q))
        best_q, best_id, best_score = best_q[order], best_id[order], best_score[order]
        first = np.searchsorted(best_q, best_q)
        top = np.arange(len(best_q)) - first < k
        best_q, best_id, best_score = best_q[top], best_id[top], best_score[top]
        full = np.flatnonzero(np.arange(len(best_q)) - np.searchsorted(best_q, best_q) == k - 1)
        bound[best_q[full]] = np.maximum(bound[best_q[full]], best_score[full])
    return best_q, best_id, best_score


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, coverage: float = 0.97, n_lists: int | None = None,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the vectors of ``queries`` against all of ``vectors``."""
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))

    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = ready(vectors).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty
    dim, n = sizes
    vectors = ready(vectors).filter(F.size("vector") == dim).withColumn("vec_id", F.coalesce("vec_id", F.lit(LAST_ID)))
    asked = ready(queries).filter(F.size("vector") == dim).filter("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    every = max(4, -(-n // most))
    in_sample = F.pmod(F.xxhash64(F.lit(3), "vec_id", "vector"), F.lit(every)) == 0
    rows = vectors.filter(in_sample).limit(most).select("vec_id", "vector").toArrow()
    if not rows.num_rows:
        rows = vectors.select("vec_id", "vector").limit(1).toArrow()
    sample_ids, sample = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector")).astype(np.float64)
    centres = fit_centres(sample, n_lists or min(MAX_LISTS, -(-n // LIST_ROWS)))
    probes = calibrate(sample, centres, k, coverage)
    shared = spark.sparkContext.broadcast((centres, sample_ids, sample, nearest_lists(sample, centres, 1)[:, 0]))  # at most SAMPLE_BYTES each

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = nearest_lists(_matrix(batch.column(1)).astype(np.float64), shared.value[0], 1)[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["list", "vec_id", "vector", "drawn"])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        centres, ids, known, lists = shared.value
        asking = _matrix(batch.column(1)).astype(np.float64)
        own = nearest_lists(asking, centres, probes).astype(np.int32)
        least = sample_bounds(batch.column(0).to_numpy(), asking, own.astype(np.int64), ids, known, lists, k)
        return pa.RecordBatch.from_arrays([pa.array(own.tolist(), pa.list_(pa.int32())), pa.array(least), *batch.columns], ["lists", "least", "query_id", "query"])

    kind = vectors.schema["vector"].dataType.simpleString()
    filed = materialize(map_batches(vectors.withColumn("drawn", in_sample), file, f"list int, vec_id long, vector {kind}, drawn boolean"), "lists")
    parts = filed.groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    cell_key = F.concat_ws("#", "list", "part", "block").alias("cell")  # one column: a deal by list alone would do for three
    blocks = max(1, -(-asked.count() // CELL_QUERIES))
    cells = (
        filed.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "parts").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(cell_key, "vec_id", "vector", "drawn")
    )
    search = (
        map_batches(asked, probe, f"lists array<int>, least double, query_id long, query {kind}")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .withColumn("list", F.explode("lists")).join(parts, "list")
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(cell_key, "query_id", "least", "query")
    )

    def cell(_: tuple, own: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not (own.num_rows and asking.num_rows):
            return schema.empty_table()
        query_ids, least, ids = asking.column("query_id").to_numpy(), asking.column("least").to_numpy(), own.column("vec_id").to_numpy()
        drawn = own.column("drawn").to_numpy(zero_copy_only=False).astype(bool)
        q, x, score = [], [], []
        for a in range(0, len(query_ids), 1024):
            found = scan(query_ids[a : a + 1024], _matrix(asking.column("query"))[a : a + 1024], least[a : a + 1024], ids, _matrix(own.column("vector")), drawn, k)
            q.append(query_ids[a + found[0]])
            x.append(found[1])
            score.append(found[2])
        return pa.table([np.concatenate(q), np.concatenate(x), np.concatenate(score)], schema=schema)

    found = cells.groupBy("cell").cogroup(search.groupBy("cell")).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(LAST_ID)).alias("vec_id"), "score")

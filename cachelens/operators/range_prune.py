"""Threshold self-join of vectors with exact metric pruning.

Every row belongs to the cell of its nearest centre, and a cell knows its smallest and largest distance
from the centre. For a row x at distance D from a cell's centre, and a member y at distance e from it, the triangle
inequality gives ``|D - e| <= d(x, y) <= D + e``. So a whole cell is skipped, or counted as a
whole, from its centre and radius alone; inside a cell that is neither, members are sorted by e, those with
``e <= t - D`` count unseen and only those with ``|D - e| <= t`` are compared. What is within
``tolerance`` of a bound is compared, so rounding never decides; results equal those of all pairs.

``broadcast``: while the table stays under ``max_broadcast_bytes`` (its rows are counted first), it is shipped
sorted by cell and the rows are scanned in place. ``grid``: beyond that, neighbouring cells are packed to
blocks of up to ``rows_per_block`` rows. Rows go as members to the blocks that may ask for their cell and
as probes to the blocks with a cell that they cannot decide. A cell over ``rows_per_block`` is
split by a hash of the id, so a task holds two blocks of bounded size, and blocks
whose cells are all too far apart meet in no task.

Centres are rows in md5 order, at most ``MAX_CELLS``: they only decide how much is pruned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.functions.draws import md5_order_key
from cachelens.operators.vector_join import (_CHUNK_ENTRIES, DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_ROWS_PER_BLOCK, _scores, _small_enough,
                                             arrow_vectors)
from cachelens.session import materialize

MAX_CELLS = 4_096
#: Probes of a cell that are compared with the members at a time, in the order of their distance.
PROBES_AT_ONCE = 128
COUNTS = "query_id long, n_within long, n_examined long"


def centre_distances(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Distances (not squared) of all rows to all centres."""
    D = np.einsum("ij,ij->i", X, X)[:, None] + np.einsum("ij,ij->i", C, C)[None, :] - 2.0 * (X @ C.T)
    return np.sqrt(np.maximum(D, 0.0))


def nearest_centres(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of every row, some rows at a time."""
    step = max(1, _CHUNK_ENTRIES // len(C))
    cell, far = np.empty(len(X), np.int64), np.empty(len(X))
    for s in range(0, len(X), step):
        D = centre_distances(X[s : s + step], C)
        cell[s : s + step] = D.argmin(axis=1)
        far[s : s + step] = D.min(axis=1)
    return cell, far


def slices(batches, n_centres: int):
    """Batches cut so that the distances of their rows to all centres stay small."""
    step = max(1, _CHUNK_ENTRIES // n_centres)
    for b in batches:
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)


def tolerance(X: np.ndarray) -> float:
    """What a distance of ``centre_distances`` may be off by, with room."""
    return 1e-6 * (1.0 + math.sqrt(float(np.einsum("ij,ij->i", X, X).max())) if len(X) else 1.0)


@dataclass
class Members:
    """A cell's rows, or a block of them, by ascending distance from the centre."""

    ids: np.ndarray
    X: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, ids, X, far):
        order = np.argsort(far, kind="stable")
        return cls(ids[order], X[order], far[order])


def count_in_cell(qids, Q, D, members: Members, threshold: float, tol: float):
    """(within, compared) for each probe at distance ``D`` from the members' centre; a member with the
    probe's own id is left out."""
    t = math.sqrt(threshold)
    within, compared = np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)
    sure = np.searchsorted(members.far, t - tol - D, "right")  # members counted unseen
    last = np.searchsorted(members.far, D + t + tol, "right")
    first = np.maximum(sure, np.searchsorted(members.far, D - t - tol, "left"))
    within += sure
    own = np.argsort(members.ids, kind="stable")
    spot = np.minimum(np.searchsorted(members.ids[own], qids), len(own) - 1)
    place = own[spot]
    within -= (members.ids[place] == qids) & (place < sure)
    order = np.argsort(D, kind="stable")
    order = order[first[order] < last[order]]
    step = max(1, min(PROBES_AT_ONCE, _CHUNK_ENTRIES // max(1, len(members.ids))))
    for s in range(0, len(order), step):
        rows = order[s : s + step]
        lo, hi = int(first[rows].min()), int(last[rows].max())
        q, x = Q[rows], members.X[lo:hi]
        near = _scores(q, np.einsum("ij,ij->i", q, q), x, "l2") <= threshold
        near &= qids[rows, None] != members.ids[None, lo:hi]
        near &= np.arange(lo, hi)[None, :] >= sure[rows, None]  # not those counted already
        within[rows] += near.sum(axis=1)
        compared[rows] += hi - lo
    return within, compared


def _counts(qids, within, compared) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(within, pa.int64()), pa.array(compared, pa.int64())], ["query_id", "n_within", "n_examined"])


def _broadcast_counts(rows: DataFrame, threshold: float, n_cells: int) -> DataFrame:
    spark = rows.sparkSession
    ids, X = arrow_vectors(rows.toArrow(), "_id", "_v")
    # centres: every n-th row by id, so that any order of the collected rows gives the same cells
    picked = np.argsort(ids, kind="stable")[np.linspace(0, len(ids) - 1, min(n_cells, len(ids))).astype(np.int64)]
    C = X[picked]
    cell, far = nearest_centres(X, C)
    order = np.lexsort((far, cell))
    starts = np.searchsorted(cell[order], np.arange(len(C) + 1))
    table = (C, [Members(ids[o], X[o].astype(np.float32), far[o]) for o in (order[a:b] for a, b in zip(starts[:-1], starts[1:]))], tolerance(X))
    shared = spark.sparkContext.broadcast(table)
    t = math.sqrt(threshold)

    def scan(batches):
        C, cells, tol = shared.value
        for b in slices(batches, len(C)):
            qids, Q = arrow_vectors(b, "_id", "_v")
            if not len(qids):
                continue
            D = centre_distances(Q, C)
            within, compared = np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)
            for at, members in enumerate(cells):
                if not len(members.ids):
                    continue
                rows = np.flatnonzero((D[:, at] - members.far[-1] <= t + tol) & (members.far[0] - D[:, at] <= t + tol))
                if len(rows):
                    wide = Members(members.ids, members.X.astype(np.float64), members.far)
                    n, seen = count_in_cell(qids[rows], Q[rows], D[rows, at], wide, threshold, tol)
                    within[rows] += n
                    compared[rows] += seen
            yield _counts(qids, within, compared)

    return rows.mapInArrow(scan, COUNTS)


def _grid_counts(rows: DataFrame, threshold: float, n_cells: int, rows_per_block: int) -> DataFrame:
    spark = rows.sparkSession
    t = math.sqrt(threshold)
    picked = rows.orderBy(md5_order_key(42, "cell", "_id"), "_id").limit(n_cells).toArrow()
    C = arrow_vectors(picked, "_id", "_v")[1]
    centres = spark.sparkContext.broadcast(C)
    vec_type = rows.schema["_v"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            ids, X = arrow_vectors(b, "_id", "_v")
            if not len(ids):
                continue
            cell, far = nearest_centres(X, centres.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far),
                                              pa.array(np.einsum("ij,ij->i", X, X))], ["_id", "_v", "cell", "far", "sq"])

    placed = materialize(rows.mapInArrow(assign, f"_id long, _v {vec_type}, cell int, far double, sq double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most"), F.max("sq").alias("sq")).collect()
    n, least, most = np.zeros(len(C), np.int64), np.full(len(C), np.inf), np.full(len(C), -np.inf)
    for r in sizes:  # one row per cell
        n[r["cell"]], least[r["cell"]], most[r["cell"]] = r["n"], r["least"], r["most"]
    tol = 1e-6 * (1.0 + math.sqrt(max((r["sq"] for r in sizes), default=0.0)))
    parts = np.maximum(1, -(-n // rows_per_block))
    pack, first_block = pack_cells(C, n, parts, rows_per_block)
    meet = np.zeros((len(C), len(C)), bool)  # probes of cell a have to see cell b
    for a in range(len(C)):
        gap = centre_distances(C[a : a + 1], C)[0]
        apart = np.maximum(gap - most[a] - most, np.maximum(least[a] - gap - most, least - gap - most[a]))
        meet[a] = (apart <= t + tol) & (n > 0) & (n[a] > 0)
    by_pack = np.argsort(pack, kind="stable")
    pack_starts = np.searchsorted(pack[by_pack], np.arange(pack.max() + 1))
    pack_parts = np.maximum.reduceat(parts[by_pack], pack_starts)  # a split cell is a pack of its own
    pack_block = np.minimum.reduceat(first_block[by_pack], pack_starts)
    asks = np.logical_or.reduceat(meet[by_pack], pack_starts, axis=0).T  # cell b: packs that hold a cell it meets
    n_centres = len(C)
    shared = spark.sparkContext.broadcast((C, n, least, most, parts, first_block, np.packbits(asks, axis=1)))

    def undecided(D, cells=slice(None)):
        """Cells that a row can neither skip nor count as a whole, and those that it counts as a whole."""
        n, least, most = (x[cells] for x in shared.value[1:4])
        whole = (D + most <= t - tol) & (n > 0)
        return (D - most <= t + tol) & (least - D <= t + tol) & (n > 0) & ~whole, whole

    def own_block(ids, cell):
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return shared.value[5][cell] + (mixed % shared.value[4][cell].astype(np.uint64)).astype(np.int64)

    def all_blocks(row, pack):
        """(row, block) for every block of the packs."""
        times = pack_parts[pack]
        row, first = np.repeat(row, times), np.repeat(pack_block[pack], times)
        return row, first + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)

    def spread(b, row, a, other):
        columns = [b.column(c).take(pa.array(row)) for c in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(other.astype(np.int32)), *columns], ["a", "b", "_id", "_v", "cell", "far"])

    def probes(batches):
        for b in slices(batches, n_centres):
            ids, X = arrow_vectors(b, "_id", "_v")
            if not len(ids):
                continue
            open_, _ = undecided(centre_distances(X, shared.value[0]))
            row, block = all_blocks(*np.nonzero(np.logical_or.reduceat(open_[:, by_pack], pack_starts, axis=1)))
            yield spread(b, row, own_block(ids, b.column(2).to_numpy())[row], block)

    def members(batches):
        for b in slices(batches, n_centres):
            ids, X = arrow_vectors(b, "_id", "_v")
            if not len(ids):
                continue
            cell = b.column(2).to_numpy()
            asked = np.unpackbits(shared.value[6][cell], axis=1, count=len(pack_starts))
            row, block = all_blocks(*np.nonzero(asked))
            yield spread(b, row, block, own_block(ids, cell)[row])

    def whole(batches):
        for b in slices(batches, n_centres):
            ids, X = arrow_vectors(b, "_id", "_v")
            if len(ids):
                _, sure = undecided(centre_distances(X, shared.value[0]))
                inside = sure[np.arange(len(ids)), b.column(2).to_numpy()]  # the row itself is one of its cell
                yield _counts(ids, sure @ shared.value[1] - inside, np.zeros(len(ids), np.int64))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, Q = arrow_vectors(left, "_id", "_v")
        ids, X = arrow_vectors(right, "_id", "_v")
        within, compared = np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)
        if len(qids) and len(ids):
            cell, far = right.column("cell").to_numpy(), right.column("far").to_numpy()
            for own in np.unique(cell):
                D = centre_distances(Q, shared.value[0][own][None, :])[:, 0]
                rows = np.flatnonzero(undecided(D, own)[0])
                if len(rows):
                    at = cell == own
                    n, seen = count_in_cell(qids[rows], Q[rows], D[rows], Members.of(ids[at], X[at], far[at]), threshold, tol)
                    within[rows] += n
                    compared[rows] += seen
        return pa.Table.from_batches([_counts(qids, within, compared)])

    schema = f"a int, b int, _id long, _v {vec_type}, cell int, far double"
    pairs = placed.mapInArrow(probes, schema).groupBy("a", "b").cogroup(placed.mapInArrow(members, schema).groupBy("a", "b")).applyInArrow(compare, COUNTS)
    return pairs.unionByName(placed.mapInArrow(whole, COUNTS))


def pack_cells(C: np.ndarray, n: np.ndarray, parts: np.ndarray, rows_per_block: int) -> tuple[np.ndarray, np.ndarray]:
    """(pack of each cell, its first block): neighbouring cells share a pack, which is one block, of up to
    ``rows_per_block`` rows; a larger cell is a pack of its own with ``parts`` blocks."""
    coarse = nearest_centres(C, C[: max(1, int(n.sum()) // rows_per_block)])[0]
    pack, first = np.zeros(len(C), np.int64), np.zeros(len(C), np.int64)
    now, block, held = 0, 0, 0
    for cell in np.argsort(coarse, kind="stable"):
        if held and held + n[cell] > rows_per_block:
            now, block, held = now + 1, block + 1, 0
        pack[cell], first[cell] = now, block
        held += n[cell]
        if parts[cell] > 1:
            now, block, held = now + 1, block + parts[cell], 0
    return pack, first


def neighbor_counts(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", *, n_cells: int | None = None,
                    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK,
                    strategy: str = "auto") -> DataFrame:
    """``COUNTS`` rows: per row (ids are unique) the other rows within squared L2 ``<= threshold``, and how
    many rows it was compared with. Rows with a null vector have zeros; a negative threshold finds none."""
    ids = vectors.select(F.col(id_col).cast("long").alias("query_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).filter("_id IS NOT NULL AND _v IS NOT NULL")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
    if threshold < 0 or not size["n"]:
        return ids.select("query_id", F.lit(0).cast("long").alias("n_within"), F.lit(0).cast("long").alias("n_examined"))
    cells = n_cells or min(MAX_CELLS, math.ceil(2 * math.sqrt(size["n"])))
    if strategy == "broadcast" or (strategy == "auto" and _small_enough(size["n"], size["dim"], size["n"], max_broadcast_bytes)):
        parts = _broadcast_counts(rows, threshold, cells)
    else:
        parts = _grid_counts(rows, threshold, cells, rows_per_block)
    sums = parts.groupBy("query_id").agg(F.sum("n_within").alias("n_within"), F.sum("n_examined").alias("n_examined"))
    zero = F.lit(0).cast("long")
    return ids.join(sums, "query_id", "left").select("query_id", F.coalesce("n_within", zero).alias("n_within"), F.coalesce("n_examined", zero).alias("n_examined"))

"""Blocked many-to-many vector joins: exact kNN, range counts and pair statistics.

Spark has no vector distance join, and a row-level cross join with array lambdas both
materialises every pair and interprets the arithmetic element by element. Here the
distance work runs in Arrow blocks with numpy matrix products, and only *reduced*
results leave a task (k rows per query, one count per query, or a few aggregate rows).

Three physical strategies, all exact, tried in this order:

``broadcast``
    The probe side (queries) is collected only after its rows have been counted and
    rows x dimension has been checked against ``max_broadcast_bytes``, and after the lists
    that all database partitions would emit (queries x rows kept x partitions) have been
    checked against ``max_partial_rows``; it is shipped once to every executor and each
    database partition is scanned batch by batch (``mapInArrow``). The database is
    never shuffled. Each task emits at most k rows per query.

``broadcast_database``
    The probe side is too big but the database passes the same check: the database is
    shipped instead and the probe side is scanned in place; each task's output is final.

``grid``
    Neither side may be broadcast: both sides are hashed into blocks of about
    ``rows_per_block`` rows, replicated along the other axis of a
    (query block x database block) grid and co-grouped by cell (``applyInArrow``).
    A task holds one query block and one database block, so its memory is bounded
    whatever the input size, and cells are uniform (hash of the row id), so a hot
    key cannot concentrate work in one task.

A table joined with itself (pair statistics) uses the upper triangle of the grid only.

Nearest neighbours are scored in float32; every pair within the rounding bound of the k-th
score is scored again in float64, so the result is the exact one.

Partial top-k lists are merged with ``row_number() <= k`` over ``(dist, neighbor_id)``,
which Spark plans as a partial and a final ``WindowGroupLimit`` around the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes (float32 vectors and ids) of the side that is shipped to executors.
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_ROWS_PER_BLOCK = 20_000
# Rows that the tasks of a broadcast join may emit in all before they are merged.
DEFAULT_MAX_PARTIAL_ROWS = 1_000_000_000
# Entries of one (query chunk x database batch) distance matrix held at once.
_CHUNK_ENTRIES = 4_000_000
# Bytes (float32 vectors) of a block of a table joined with itself, and tasks of such a join.
TRIANGLE_BLOCK_BYTES = 16 * 1024 * 1024
MAX_TRIANGLE_TASKS = 2_000


# ----------------------------------------------------------------------------------------
# numpy helpers (run inside tasks)
# ----------------------------------------------------------------------------------------

def arrow_vectors(batch, id_col: str, vec_col: str, dtype=np.float64):
    """(ids int64[n], X dtype[n, dim]) from an Arrow batch/table; null vectors are skipped."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
        ids_arr = batch.column(id_col).chunk(0) if batch.num_rows else pa.array([], pa.int64())
        vec_arr = batch.column(vec_col).chunk(0) if batch.num_rows else None
    else:
        ids_arr = batch.column(id_col)
        vec_arr = batch.column(vec_col)
    if batch.num_rows == 0 or vec_arr is None:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=dtype)
    valid = vec_arr.is_valid()
    if valid.false_count:
        ids_arr = ids_arr.filter(valid)
        vec_arr = vec_arr.filter(valid)
    ids = ids_arr.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    n = len(ids)
    if n == 0:
        return ids, np.zeros((0, 0), dtype=dtype)
    lengths = vec_arr.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(lengths[0])
    if not np.all(lengths == dim):
        raise ValueError("vectors of different dimensions in one table")
    flat = vec_arr.flatten().to_numpy(zero_copy_only=False)
    X = np.asarray(flat, dtype=dtype).reshape(n, dim)
    return ids, X


def _scores(Q: np.ndarray, qn: np.ndarray, X: np.ndarray, metric: str) -> np.ndarray:
    """Matrix to minimise: squared L2 (clamped at 0), negated inner product, or the
    Hamming distance of packed 64-bit code words."""
    if metric == "hamming":
        x = np.bitwise_xor(Q[:, None, :].view(np.uint64), X[None, :, :].view(np.uint64))
        return np.bitwise_count(x).sum(axis=2).astype(np.float64)
    S = Q @ X.T
    if metric == "ip":
        return -S
    D = qn[:, None] + np.einsum("ij,ij->i", X, X)[None, :] - 2.0 * S
    np.maximum(D, 0.0, out=D)
    return D


def _smallest_k(M: np.ndarray, k: int):
    """(row, col) of the k smallest entries per row, plus every entry tied with the k-th.

    ``argpartition`` picks k + 1 candidates per row; only rows where the (k+1)-th equals the
    k-th (a tie across the cut) fall back to a full comparison."""
    m, n = M.shape
    if n <= k:
        r, c = np.nonzero(np.ones_like(M, dtype=bool))
        return r, c
    kk = min(k + 1, n)
    part = np.argpartition(M, kk - 1, axis=1)[:, :kk]
    vals = np.take_along_axis(M, part, axis=1)
    order = np.argsort(vals, axis=1, kind="stable")
    part = np.take_along_axis(part, order, axis=1)
    vals = np.take_along_axis(vals, order, axis=1)
    rows = np.repeat(np.arange(m), k)
    cols = part[:, :k].reshape(-1)
    if kk > k:
        tie = np.flatnonzero(vals[:, k] == vals[:, k - 1])
        if len(tie):
            keep = ~np.isin(rows, tie)
            tr, tc = np.nonzero(M[tie] <= vals[tie, k - 1][:, None])
            rows = np.concatenate([rows[keep], tie[tr]])
            cols = np.concatenate([cols[keep], tc])
    return rows, cols


def _rank_within(rows: np.ndarray) -> np.ndarray:
    if len(rows) == 0:
        return np.zeros(0, dtype=np.int64)
    start = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    counts = np.diff(np.r_[start, len(rows)])
    return np.arange(len(rows)) - np.repeat(start, counts)


def _merge_topk(rows, d, ids, k):
    order = np.lexsort((ids, d, rows))
    rows, d, ids = rows[order], d[order], ids[order]
    keep = _rank_within(rows) < k
    return rows[keep], d[keep], ids[keep]


# ----------------------------------------------------------------------------------------
# kernels: what is computed for one (query block, database block) pair
# ----------------------------------------------------------------------------------------

@dataclass
class TopK:
    """k smallest ``dist`` (squared L2) or largest ``score`` (inner product) per query."""

    k: int
    metric: str = "l2"
    exclude_self: bool = False

    @property
    def vec_dtype(self):
        return np.int64 if self.metric == "hamming" else np.float32

    @property
    def rows_per_query(self) -> int:
        return self.k

    def _val(self) -> str:
        return {"ip": "score", "hamming": "hamming"}.get(self.metric, "dist")

    def schema(self) -> str:
        return f"query_id long, neighbor_id long, {self._val()} double"

    def init(self, qids, Q):
        return {"rows": np.zeros(0, np.int64), "d": np.zeros(0), "ids": np.zeros(0, np.int64)}

    def update(self, st, qids, Q, qn, xids, X):
        m, n = len(qids), len(xids)
        if m == 0 or n == 0:
            return
        width = X.shape[1] if self.metric == "hamming" else 1
        step = max(1, _CHUNK_ENTRIES // max(n * width, 1))
        parts_r, parts_d, parts_i = [st["rows"]], [st["d"]], [st["ids"]]
        for s in range(0, m, step):
            e = min(m, s + step)
            same = qids[s:e, None] == xids[None, :] if self.exclude_self else None
            if self.metric == "hamming":
                M = _scores(Q[s:e], None, X, self.metric)
                if same is not None:
                    M[same] = np.inf
                r, c = _smallest_k(M, self.k)
                dv = M[r, c]
                fin = np.isfinite(dv)
                r, c, dv = r[fin], c[fin], dv[fin]
            else:
                r, c, dv = self._exact(Q[s:e], X, same)
            parts_r.append(r + s)
            parts_d.append(dv)
            parts_i.append(xids[c])
        rows = np.concatenate(parts_r)
        d = np.concatenate(parts_d)
        ids = np.concatenate(parts_i)
        st["rows"], st["d"], st["ids"] = _merge_topk(rows, d, ids, self.k)

    def _exact(self, Q, X, same):
        """(row, col, value) of every pair that may be among a row's k smallest: float32 scores
        pick the pairs within twice the rounding bound of the k-th, float64 scores them."""
        M = Q @ X.T
        xn = np.einsum("ij,ij->i", X, X)
        qmax, xmax = np.sqrt(np.einsum("ij,ij->i", Q, Q)).astype(np.float64), float(np.sqrt(xn.max()))
        if self.metric == "l2":  # the row's own norm does not change its order
            M *= -2.0
            M += xn[None, :]
        else:
            np.negative(M, out=M)
        if same is not None:
            M[same] = np.inf
        if M.shape[1] > self.k:
            bound = 1.2e-7 * (Q.shape[1] + 4) * (2.0 * qmax * xmax + xmax * xmax)
            cut = np.partition(M, self.k - 1, axis=1)[:, self.k - 1] + 2.0 * bound
            r, c = np.nonzero(M <= cut[:, None])
        else:
            r, c = np.nonzero(np.ones(M.shape, dtype=bool))
        fin = np.isfinite(M[r, c])
        r, c = r[fin], c[fin]
        q, x = Q[r].astype(np.float64), X[c].astype(np.float64)
        if self.metric == "l2":
            q -= x
            return r, c, np.einsum("ij,ij->i", q, q)
        return r, c, -np.einsum("ij,ij->i", q, x)

    def emit(self, st, qids):
        val = -st["d"] if self.metric == "ip" else st["d"]
        name = self._val()
        return pa.table({
            "query_id": pa.array(qids[st["rows"]], pa.int64()),
            "neighbor_id": pa.array(st["ids"], pa.int64()),
            name: pa.array(val, pa.float64()),
        })


@dataclass
class RangeCount:
    """Number of database rows with squared L2 ``<= threshold`` per query (self excluded)."""

    threshold: float
    exclude_self: bool = True
    rows_per_query = 1

    def schema(self) -> str:
        return "query_id long, n_within long"

    def init(self, qids, Q):
        return {"cnt": np.zeros(len(qids), np.int64)}

    def update(self, st, qids, Q, qn, xids, X):
        m, n = len(qids), len(xids)
        if m == 0 or n == 0:
            return
        step = max(1, _CHUNK_ENTRIES // max(n, 1))
        for s in range(0, m, step):
            e = min(m, s + step)
            within = _scores(Q[s:e], qn[s:e], X, "l2") <= self.threshold
            if self.exclude_self:
                within &= qids[s:e, None] != xids[None, :]
            st["cnt"][s:e] += within.sum(axis=1)

    def emit(self, st, qids):
        nz = st["cnt"] > 0
        return pa.table({"query_id": pa.array(qids[nz], pa.int64()),
                         "n_within": pa.array(st["cnt"][nz], pa.int64())})


@dataclass
class PairStats:
    """Distribution of the inner product over unordered pairs (query id < database id).

    Emits one row per histogram bin touched in the task: count, sum, smallest and largest value, count of
    values >= each cut, and pairs multiplied out. With ``lo == hi`` every value falls into bin 0.

    The rows of a block are grouped around a few of them. With group centres a, b and radii r, s, every
    product of two groups lies within ``|a| s + |b| r + r s`` of ``a . b``. If that interval lies in one
    bin, holds no cut, and widens the range seen so far by nothing, the pairs are counted as a whole (and
    summed by the sums of the rows with larger ids).
    """

    lo: float = 0.0
    hi: float = 0.0
    bins: int = 1
    cuts: tuple = ()
    groups: int = 64
    rows_per_query = 0

    def schema(self) -> str:
        cut_cols = "".join(f", n_ge_{i} long" for i in range(len(self.cuts)))
        return f"bin int, n long, s double, vmin double, vmax double, examined long{cut_cols}"

    def init(self, qids, Q):
        b = self.bins
        return {"n": np.zeros(b, np.int64), "s": np.zeros(b), "mn": np.full(b, np.inf), "mx": np.full(b, -np.inf), "seen": np.zeros(b, np.int64),
                "ge": np.zeros((b, len(self.cuts)), np.int64)}

    def _bin(self, v):
        if self.hi <= self.lo:
            return np.zeros(np.shape(v), np.int64)
        # values are clamped into the range found by the first pass (recomputed
        # products may differ from it in the last bit)
        return np.clip(np.floor((v - self.lo) / ((self.hi - self.lo) / self.bins)), 0, self.bins - 1).astype(np.int64)

    def _grouped(self, ids, X):
        """(ids, rows, group starts, centres, radii), rows by group."""
        C = X[np.linspace(0, len(X) - 1, min(self.groups, len(X))).astype(np.int64)]
        own = (np.einsum("ij,ij->i", C, C)[None, :] - 2.0 * (X @ C.T)).argmin(axis=1)
        order = np.lexsort((ids, own))
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        X, sizes = X[order], np.diff(np.r_[starts, len(X)])
        centres = np.add.reduceat(X, starts, axis=0) / sizes[:, None]
        away = X - np.repeat(centres, sizes, axis=0)
        radii = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), starts))
        return ids[order], X, np.r_[starts, len(X)], centres, radii

    @staticmethod
    def _bounds(qc, qr, xc, xr):
        """Smallest and largest product that two groups with these centres and radii may hold."""
        qsize, xsize = np.sqrt(np.einsum("ij,ij->i", qc, qc)), np.sqrt(np.einsum("ij,ij->i", xc, xc))
        wide = qsize[:, None] * xr[None, :] + xsize[None, :] * qr[:, None] + qr[:, None] * xr[None, :]
        wide += 1e-9 * (1.0 + (qsize + qr)[:, None] * (xsize + xr)[None, :])  # room for rounding
        middle = qc @ xc.T
        return middle - wide, middle + wide

    def update(self, st, qids, Q, qn, xids, X):
        if len(qids) == 0 or len(xids) == 0:
            return
        qids, Q, qs, qc, qr = self._grouped(qids, Q)
        xids, X, xs, xc, xr = self._grouped(xids, X)
        low, high = self._bounds(qc, qr, xc, xr)
        middle = qc @ xc.T
        single = self._bin(low) == self._bin(high)
        for cut in self.cuts:
            single &= (low >= cut) | (high < cut)
        for g in range(len(qr)):
            rows = slice(qs[g], qs[g + 1])
            whole = single[g] & (low[g] >= st["mn"].min()) & (high[g] <= st["mx"].max())
            for h in np.flatnonzero(whole):
                own = X[xs[h] : xs[h + 1]]
                after = np.searchsorted(xids[xs[h] : xs[h + 1]], qids[rows], "right")  # rows are by id within a group
                n = int((len(own) - after).sum())
                at = int(self._bin(middle[g, h]))
                st["n"][at] += n
                larger = np.vstack([np.cumsum(own[::-1], axis=0)[::-1], np.zeros(own.shape[1])])
                st["s"][at] += float(np.einsum("ij,ij->", Q[rows], larger[after]))
                st["ge"][at] += n * (low[g, h] >= np.array(self.cuts))
            if whole.all():
                continue
            open_ = np.repeat(~whole, np.diff(xs))
            self._multiply(st, qids[rows], Q[rows], xids[open_], X[open_])

    def _multiply(self, st, qids, Q, xids, X):
        step = max(1, _CHUNK_ENTRIES // len(xids))
        for s in range(0, len(qids), step):
            v = (Q[s : s + step] @ X.T)[qids[s : s + step, None] < xids[None, :]]
            if v.size == 0:
                continue
            b = self._bin(v)
            n = np.bincount(b, minlength=self.bins)
            st["n"] += n
            st["s"] += np.bincount(b, weights=v, minlength=self.bins)
            st["seen"] += n
            np.minimum.at(st["mn"], b, v)
            np.maximum.at(st["mx"], b, v)
            for j, cut in enumerate(self.cuts):
                st["ge"][:, j] += np.bincount(b, weights=(v >= cut), minlength=self.bins).astype(np.int64)

    def emit(self, st, qids):
        nz = np.flatnonzero(st["n"] > 0)
        cols = {
            "bin": pa.array(nz.astype(np.int32), pa.int32()),
            "n": pa.array(st["n"][nz], pa.int64()),
            "s": pa.array(st["s"][nz], pa.float64()),
            "vmin": pa.array(st["mn"][nz], pa.float64(), mask=np.isinf(st["mn"][nz])),
            "vmax": pa.array(st["mx"][nz], pa.float64(), mask=np.isinf(st["mx"][nz])),
            "examined": pa.array(st["seen"][nz], pa.int64()),
        }
        for j in range(len(self.cuts)):
            cols[f"n_ge_{j}"] = pa.array(st["ge"][nz, j], pa.int64())
        return pa.table(cols)


@dataclass
class PairCounts(PairStats):
    """``PairStats`` without sums: pairs by bin (at most 256), or with one bin their number, those at or above each cut
    and, with ``ends``, the smallest and largest value.

    Products are taken in float32, in tiles that stay in a core's cache. Those within the rounding bound of a bin's
    edge, a cut or the ends found so far are taken again in float64; a tile with many of them is
    multiplied out in float64. So the counts are the exact ones.
    """

    ends: bool = False

    def update(self, st, qids, Q, qn, xids, X):
        if len(qids) == 0 or len(xids) == 0:
            return
        if not max(np.abs(Q).max(), np.abs(X).max()) < 1e15:  # not for float32
            super().update(st, qids, Q, qn, xids, X)
            return
        qids, Q, qs, qc, qr = self._grouped(qids, Q)
        xids, X, xs, xc, xr = self._grouped(xids, X)
        low, high = self._bounds(qc, qr, xc, xr)
        at = self._bin(low)
        single = at == self._bin(high)
        for cut in self.cuts:
            single &= (low >= cut) | (high < cut)
        Q32, X32 = Q.astype(np.float32), X.astype(np.float32)
        for g in range(len(qr)):
            rows = slice(qs[g], qs[g + 1])
            whole = single[g]
            if self.ends:
                whole = whole & (low[g] >= st["mn"].min()) & (high[g] <= st["mx"].max())
            for h in np.flatnonzero(whole):
                after = np.searchsorted(xids[xs[h] : xs[h + 1]], qids[rows], "right")  # rows are by id within a group
                n = int((xs[h + 1] - xs[h] - after).sum())
                st["n"][at[g, h]] += n
                st["ge"][at[g, h]] += n * (low[g, h] >= np.array(self.cuts))
            if whole.all():
                continue
            left = qids[rows], Q[rows], Q32[rows]
            if whole.any():
                open_ = np.repeat(~whole, np.diff(xs))
                self._tiles(st, *left, xids[open_], X[open_], X32[open_])
            else:
                self._tiles(st, *left, xids, X, X32)

    def _tiles(self, st, qids, Q, Q32, xids, X, X32, height: int = 256, width: int = 1024):
        bound = 1.2e-7 * (Q.shape[1] + 4) * math.sqrt(np.einsum("ij,ij->i", Q, Q).max() * np.einsum("ij,ij->i", X, X).max()) + 1e-36
        held = np.empty(height * width, np.float32)
        for r in range(0, len(qids), height):
            q, q32 = Q[r : r + height], Q32[r : r + height]
            last = qids[r : r + height].max()
            for c in range(0, len(xids), width):
                x, x32 = X[c : c + width], X32[c : c + width]
                tile = held[: len(q) * len(x)].reshape(len(q), len(x))
                np.matmul(q32, x32.T, out=tile)
                own = None  # places of the pairs that count, all by default
                v = tile.ravel()
                if last >= xids[c : c + width].min():
                    own = np.flatnonzero(qids[r : r + height, None] < xids[None, c : c + width])
                    v = v[own]
                if not len(v):
                    continue
                st["seen"][0] += len(v)

                def exact(where, q=q, x=x, own=own, size=len(v)):
                    """float64 products at some places of ``v``."""
                    if 20 * len(where) > size:
                        every = (q @ x.T).ravel()
                        return (every if own is None else every[own])[where]
                    i, j = np.divmod(where if own is None else own[where], len(x))
                    return np.einsum("ij,ij->i", q[i], x[j])

                if self.bins > 1:
                    self._count_bins(st, v, bound, exact)
                else:
                    st["n"][0] += len(v)
                    self._count_ends(st, v, bound, exact)

    def _count_ends(self, st, v, bound, exact):
        if self.ends:
            for name, best, worse, sign in (("mx", v.max(), np.greater_equal, -1.0), ("mn", v.min(), np.less_equal, 1.0)):
                if (best - sign * bound - st[name][0]) * sign < 0:
                    found = exact(np.flatnonzero(worse(v, best + sign * 2.0 * bound)))
                    st[name][0] = max(st[name][0], found.max()) if sign < 0 else min(st[name][0], found.min())
        most = v.max() if self.cuts else 0.0
        for j, cut in enumerate(self.cuts):
            if most < cut - bound:
                continue
            sure = np.count_nonzero(v > cut + bound)
            near = np.flatnonzero((v >= cut - bound) & (v <= cut + bound))
            st["ge"][0, j] += sure + (np.count_nonzero(exact(near) >= cut) if len(near) else 0)

    def _count_bins(self, st, v, bound, exact):
        if self.hi <= self.lo:
            st["n"][0] += len(v)
            return
        scale = self.bins / (self.hi - self.lo)
        v *= np.float32(scale)
        v += np.float32(-self.lo * scale)
        room = bound * scale + 4e-7 * (abs(self.lo * scale) + abs(self.hi * scale) + self.bins)
        off = np.rint(v)
        off -= v
        np.abs(off, out=off)
        near = np.flatnonzero(off <= room)
        near = near[(v[near] > 0.5) & (v[near] < self.bins - 0.5)]  # the outer edges are no edges
        np.clip(v, 0, self.bins - 1, out=v)
        own = v.astype(np.uint8)
        two = own[: len(own) // 2 * 2].view(np.uint16)  # two bins at a time
        n = np.bincount(two, minlength=1 << 16).reshape(256, 256)
        n = n.sum(axis=0) + n.sum(axis=1)
        if len(own) % 2:
            n[own[-1]] += 1
        st["n"] += n[: self.bins]
        if len(near):
            st["n"] += np.bincount(self._bin(exact(near)), minlength=self.bins) - np.bincount(own[near], minlength=self.bins)

    def emit(self, st, qids):
        if self.bins > 1 and st["n"].any():  # pairs multiplied out, by task
            first = int(np.flatnonzero(st["n"])[0])
            st["seen"][first], st["seen"][0] = st["seen"][0], 0 if first else st["seen"][0]
        out = super().emit(st, qids)
        return out.set_column(out.column_names.index("s"), "s", pa.nulls(out.num_rows, pa.float64()))


# ----------------------------------------------------------------------------------------
# physical strategies
# ----------------------------------------------------------------------------------------

def _small_enough(rows: int, dim: int, max_rows: int, max_bytes: int) -> bool:
    """Whether ``rows`` float32 vectors with ids stay within both bounds."""
    return rows <= max_rows and rows * (4 * dim + 8) <= max_bytes


def _run_kernel(kernel, qids, Q, xids_X_iter):
    qn = np.einsum("ij,ij->i", Q, Q) if (Q.size and Q.dtype == np.float64) else np.zeros(len(qids))
    st = kernel.init(qids, Q)
    for xids, X in xids_X_iter:
        if len(xids) and Q.size and X.shape[1] != Q.shape[1]:
            raise ValueError(f"dimension mismatch: queries {Q.shape[1]}, database {X.shape[1]}")
        kernel.update(st, qids, Q, qn, xids, X)
    return kernel.emit(st, qids)


def block_join(queries: DataFrame, database: DataFrame, kernel, *,
               q_id: str = "query_id", q_vec: str = "embedding",
               d_id: str = "id", d_vec: str = "embedding",
               max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               max_partial_rows: int = DEFAULT_MAX_PARTIAL_ROWS,
               rows_per_block: int = DEFAULT_ROWS_PER_BLOCK,
               strategy: str = "auto", triangle: bool = False) -> DataFrame:
    """Run ``kernel`` over every (query, database row) pair without materialising pairs.

    ``triangle``: both sides are the same table and the kernel takes pairs with query id <
    database id only; the grid then holds each pair of blocks once."""
    spark = queries.sparkSession
    q = queries.select(F.col(q_id).cast("long").alias("_qid"), F.col(q_vec).alias("_qv")) \
        .filter(F.col("_qv").isNotNull())
    d = database.select(F.col(d_id).cast("long").alias("_did"), F.col(d_vec).alias("_dv")) \
        .filter(F.col("_dv").isNotNull())
    schema = kernel.schema()
    dt = getattr(kernel, "vec_dtype", np.float64)
    fits = dict(max_rows=max_broadcast_rows, max_bytes=max_broadcast_bytes)
    shape = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("dim")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    dim, n_q = shape["dim"], shape["n"]

    if strategy in ("auto", "broadcast") and not (triangle and strategy == "auto"):
        lists = n_q * kernel.rows_per_query
        probe = _small_enough(n_q, dim, **fits) and (strategy == "broadcast" or lists * d.rdd.getNumPartitions() <= max_partial_rows)
        if not probe and strategy == "broadcast":
            raise ValueError("probe side exceeds the broadcast bound")
        if probe:
            bc = spark.sparkContext.broadcast(arrow_vectors(q.toArrow(), "_qid", "_qv", dt))

            def scan(batches):
                b_qids, b_Q = bc.value
                tbl = _run_kernel(kernel, b_qids, b_Q,
                                  (arrow_vectors(b, "_did", "_dv", dt) for b in batches))
                yield from tbl.to_batches()

            return d.mapInArrow(scan, schema)

    n_rows = n_q if triangle else d.count()
    if strategy in ("auto", "broadcast_database") and not (triangle and strategy == "auto"):
        # the database is shipped instead and the probe side scanned; every task then sees all
        # database rows for its queries, so its output is already final (the merge above it
        # finds one list per query)
        if _small_enough(n_rows, dim, **fits):
            return scan_probe_side(q, d, kernel, "_qid", "_qv", "_did", "_dv")
        if strategy == "broadcast_database":
            raise ValueError("database side exceeds the broadcast bound")

    # grid strategy: bounded blocks on both sides
    n_qb = max(1, math.ceil(n_q / rows_per_block))
    if triangle and strategy == "auto":
        # a pair of blocks is a task: blocks of bounded bytes, and enough pairs to keep all cores busy
        spread = max(12, math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
        n_qb = max(math.ceil(n_q * 4 * dim / TRIANGLE_BLOCK_BYTES), min(math.ceil(n_q / 1000), spread))
    n_db = n_qb if triangle else max(1, math.ceil(n_rows / rows_per_block))
    other = F.sequence(F.col("_qb"), F.lit(n_db - 1)) if triangle else F.sequence(F.lit(0), F.lit(n_db - 1))
    qg = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(n_qb)).cast("int"))
          .withColumn("_db", F.explode(other)))
    mine = F.sequence(F.lit(0), F.col("_db")) if triangle else F.sequence(F.lit(0), F.lit(n_qb - 1))
    dg = (d.withColumn("_db", F.pmod(F.xxhash64("_did"), F.lit(n_db)).cast("int"))
          .withColumn("_qb", F.explode(mine)))

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qids, Q = arrow_vectors(left, "_qid", "_qv", dt)
        xids, X = arrow_vectors(right, "_did", "_dv", dt)
        if triangle and key[0].as_py() != key[1].as_py():
            qids, xids = np.full(len(qids), np.iinfo(np.int64).min), np.zeros(len(xids), np.int64)  # every pair of two blocks counts once
        return _run_kernel(kernel, qids, Q, [(xids, X)])

    qg, dg = qg.select("_qb", "_db", "_qid", "_qv"), dg.select("_qb", "_db", "_did", "_dv")
    if triangle and n_qb > 1:
        # few bytes, much work: a number of partitions of its own, which small blocks do not merge
        tasks = min(MAX_TRIANGLE_TASKS, n_qb * (n_qb + 1))
        qg, dg = qg.repartition(tasks, "_qb", "_db"), dg.repartition(tasks, "_qb", "_db")
    return (qg.groupBy("_qb", "_db").cogroup(dg.groupBy("_qb", "_db"))
            .applyInArrow(cell, schema))


def scan_probe_side(queries: DataFrame, database: DataFrame, kernel, q_id: str, q_vec: str, d_id: str, d_vec: str) -> DataFrame:
    """``kernel`` with a database of checked size shipped to every task; ``queries`` may be a stream."""
    dt = getattr(kernel, "vec_dtype", np.float64)
    small = database.select(F.col(d_id).cast("long").alias("_did"), F.col(d_vec).alias("_dv")).toArrow()
    bc = database.sparkSession.sparkContext.broadcast(arrow_vectors(small, "_did", "_dv", dt))

    def scan(batches):
        xids, X = bc.value
        for b in batches:
            qids, Q = arrow_vectors(b, "_qid", "_qv", dt)
            if len(qids):
                yield from _run_kernel(kernel, qids, Q, [(xids, X)]).to_batches()

    return queries.select(F.col(q_id).cast("long").alias("_qid"), F.col(q_vec).alias("_qv")).mapInArrow(scan, kernel.schema())


# ----------------------------------------------------------------------------------------
# public operators
# ----------------------------------------------------------------------------------------

def knn(queries: DataFrame, database: DataFrame, k: int, *, metric: str = "l2",
        q_id: str = "query_id", q_vec: str = "embedding",
        d_id: str = "id", d_vec: str = "embedding",
        exclude_self: bool = False, **strategy) -> DataFrame:
    """Exact k nearest neighbours: ``(query_id, rank, neighbor_id, dist|score)``.

    Ascending squared L2 (``metric='l2'``) or descending inner product (``'ip'``); ties
    by neighbour id. Fewer than k database rows give fewer rows; a missing neighbour
    is an absent row."""
    metric = metric.lower()
    if metric not in ("l2", "ip", "hamming"):
        raise ValueError(f"unknown metric {metric!r}; use 'l2', 'ip' or 'hamming'")
    kern = TopK(k=k, metric=metric, exclude_self=exclude_self)
    part = block_join(queries, database, kern, q_id=q_id, q_vec=q_vec, d_id=d_id, d_vec=d_vec, **strategy)
    val = kern._val()
    if k == 1:
        # nearest only: min(struct(value, id)) is combined map-side and ships one short row of
        # numbers per query and task (sorted by query: a struct has no hash aggregate)
        key = (-F.col(val)) if metric == "ip" else F.col(val)
        best = part.groupBy("query_id").agg(F.min(F.struct(key.alias("_k"), F.col("neighbor_id").alias("_n"),
                                                           F.col(val).alias("_v"))).alias("_b"))
        return best.select("query_id", F.lit(1).alias("rank"), F.col("_b._n").alias("neighbor_id"),
                           F.col("_b._v").alias(val))
    order = F.col(val).desc() if metric == "ip" else F.col(val).asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("neighbor_id").asc())
    return (part.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", val))


def range_count(queries: DataFrame, database: DataFrame, threshold: float, *,
                q_id: str = "query_id", q_vec: str = "embedding",
                d_id: str = "id", d_vec: str = "embedding",
                exclude_self: bool = True, **strategy) -> DataFrame:
    """``(query_id, n_within)`` for every query (zero counts kept), squared L2 ``<= threshold``."""
    part = block_join(queries, database, RangeCount(threshold, exclude_self),
                      q_id=q_id, q_vec=q_vec, d_id=d_id, d_vec=d_vec, **strategy)
    sums = part.groupBy("query_id").agg(F.sum("n_within").alias("n_within"))
    ids = queries.select(F.col(q_id).cast("long").alias("query_id"))
    return (ids.join(sums, "query_id", "left")
            .select("query_id", F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within")))


def pair_stats(vectors: DataFrame, *, id_col: str = "id", vec_col: str = "embedding",
               lo: float = 0.0, hi: float = 0.0, bins: int = 1, cuts=(), sums: bool = True, ends: bool = True, **strategy) -> DataFrame:
    """Per bin the count, sum, smallest and largest inner product over unordered pairs of ``vectors``, the counts at or above
    each cut, and how many pairs were multiplied out (see ``PairStats``). Callers that need no ``sums``, and no ``ends`` by bin,
    get counts by the faster ``PairCounts``; what it does not find is null."""
    kern = PairStats(lo=lo, hi=hi, bins=bins, cuts=tuple(cuts))
    if not sums and (bins == 1 or bins <= 256 and not cuts and not ends):
        kern = PairCounts(lo=lo, hi=hi, bins=bins, cuts=tuple(cuts), ends=ends)
    part = block_join(vectors, vectors, kern, q_id=id_col, q_vec=vec_col,
                      d_id=id_col, d_vec=vec_col, triangle=True, **strategy)
    aggs = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("examined").alias("examined")]
    aggs += [F.sum(f"n_ge_{j}").alias(f"n_ge_{j}") for j in range(len(cuts))]
    return part.groupBy("bin").agg(*aggs)

"""Vector-table operators: validation, append/remove, lookups, pair statistics (B6, E6-E14),
nearest-centre assignment (E8) and the vector quality metrics (F1, F8, F17, F18, F21)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.draws import md5_order_key
from cachelens.functions.vector import has_nan, norm, norm_sq
from cachelens.operators.range_prune import neighbor_counts
from cachelens.operators.vector_join import arrow_vectors, knn, pair_stats


# ------------------------------------------------------------------------------ B6

def validate_embeddings(emb: DataFrame, vec_col: str = "embedding", dim: int | None = None,
                        tol: float = 1e-5) -> DataFrame:
    """Drop vectors containing NaN (or of the wrong dimension); flag non-unit norms."""
    ok = ~has_nan(F.col(vec_col))
    if dim is not None:
        ok = ok & (F.size(vec_col) == dim)
    return emb.filter(F.col(vec_col).isNotNull() & ok) \
        .withColumn("unit_norm", F.abs(norm(F.col(vec_col)) - 1.0) <= tol)


# ------------------------------------------------------------------------------ E6, E7

def vectors_append(base: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Append ``new`` rows with ids continuing after the largest id of ``base``; ``src_id``
    keeps every row's original id. New ids follow the original id order (range-partitioned
    numbering, no global window)."""
    from cachelens.operators.ordering import dense_ids

    start = base.agg(F.coalesce(F.max(id_col) + 1, F.lit(0))).scalar()
    numbered = dense_ids(new.withColumnRenamed(id_col, "src_id"), ["src_id"], out_col="_n")
    appended = numbered.withColumn(id_col, F.col("_n") + start).drop("_n")
    return base.withColumn("src_id", F.col(id_col)).unionByName(appended, allowMissingColumns=True)


def vectors_remove(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove rows by id (anti join)."""
    return table.join(ids.select(id_col), id_col, "left_anti")


# ------------------------------------------------------------------------------ E10

def threshold_neighbors(vectors: DataFrame, threshold: float, id_col: str = "id",
                        vec_col: str = "embedding", examined: bool = False, **options) -> DataFrame:
    """Per row: how many other rows lie within squared L2 ``<= threshold`` (zeros kept), with cells
    pruned by the triangle inequality (``range_prune``). ``examined`` adds the rows compared."""
    out = neighbor_counts(vectors, threshold, id_col, vec_col, **options).withColumnRenamed("query_id", id_col)
    return out if examined else out.drop("n_examined")


# ------------------------------------------------------------------------------ E11, E12

def lookup(queries: DataFrame, cache: DataFrame, k: int = 1, threshold: float | None = None, *,
           q_id: str = "query_id", c_id: str = "cache_id", vec_col: str = "embedding",
           active_col: str | None = "is_active", **strategy) -> DataFrame:
    """Nearest *active* entries per query; ``hit`` iff the nearest exists and is within threshold."""
    live = cache.filter(F.col(active_col)) if active_col else cache
    res = knn(queries, live, k, q_id=q_id, q_vec=vec_col, d_id=c_id, d_vec=vec_col, **strategy)
    w = Window.partitionBy("query_id")  # k rows per query
    best = F.min("dist").over(w)
    hit = F.lit(True) if threshold is None else (best <= F.lit(float(threshold)))
    return res.withColumn("hit", hit)


def batch_lookup(queries: DataFrame, cache: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Lookup for many queries without the active filter (dead entries included)."""
    kw.setdefault("active_col", None)
    return lookup(queries, cache, k, None, **kw).drop("hit")


# ------------------------------------------------------------------------------ E13, E14

def md5_sample(df: DataFrame, n: int, seed: int = 42, salt: str = "sample", id_col: str = "id") -> DataFrame:
    """Exactly min(n, rows) rows, md5-random. Only the (md5, id) keys go through the top-n
    (or, for large n, the range-partitioned numbering); the rows themselves are filtered in
    place against the cut-off key, so wide rows (vectors) never meet in one task."""
    from cachelens.operators.sampling import first_n_flag

    return df.filter(first_n_flag(df, [md5_order_key(seed, salt, id_col), F.col(id_col)], n))


def pair_moments(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row ``(n_pairs, mean, std)`` of the inner product over ALL unordered pairs, in one pass.

    The sum over pairs follows from the sum vector, the sum of squares from the Gram matrix
    ``X^T X``; a task emits both once per batch (dim and dim^2 numbers)."""
    def scan(batches):
        for b in batches:
            _, X = arrow_vectors(b, "_id", "_v")
            if len(X) == 0:
                continue
            sq = (X * X).sum(axis=1)
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(X)], pa.int64()), "nsq": pa.array([sq.sum()], pa.float64()), "n4": pa.array([(sq * sq).sum()], pa.float64()),
                "s": pa.array([X.sum(axis=0)], pa.list_(pa.float64())), "g": pa.array([(X.T @ X).ravel()], pa.list_(pa.float64()))})

    parts = vectors.select(F.lit(0).cast("long").alias("_id"), F.col(vec_col).alias("_v")) \
        .mapInArrow(scan, "n long, nsq double, n4 double, s array<double>, g array<double>")

    def squares(col: str):
        return parts.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x"))).scalar()

    base = parts.agg(F.sum("n").alias("n"), F.sum("nsq").alias("nsq"), F.sum("n4").alias("n4"))
    n_pairs = F.col("n") * (F.col("n") - 1) / 2
    total, total_sq = (squares("s") - F.col("nsq")) / 2, (squares("g") - F.col("n4")) / 2
    mean = total / n_pairs
    return base.select(n_pairs.cast("long").alias("n_pairs"), mean.alias("mean"),
                       F.sqrt(F.greatest(F.lit(0.0), total_sq / n_pairs - mean * mean)).alias("std"))


def _pair_range(vectors: DataFrame, id_col: str, vec_col: str, cuts=(), ends: bool = True) -> DataFrame:
    """One row: pairs, smallest and largest inner product (with ``ends``), and counts at or above each cut."""
    per = pair_stats(vectors, id_col=id_col, vec_col=vec_col, cuts=cuts, sums=False, ends=ends)
    return per.agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"),
                   *[F.sum(f"n_ge_{j}").alias(f"n_ge_{j}") for j in range(len(cuts))])


def pairwise_cosine(vectors: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Count, mean, std (closed form), min and max (pair blocks) over all unordered pairs."""
    ends = _pair_range(vectors, id_col, vec_col)
    return pair_moments(vectors, vec_col).crossJoin(ends).select(  # one row each
        "n_pairs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        F.round("vmin", 6).alias("min"), F.round("vmax", 6).alias("max"))


def pairwise_histogram(vectors: DataFrame, id_col: str, vec_col: str = "embedding", bins: int = 100) -> DataFrame:
    """Density histogram (100 bins over [min, max]) of all pairs and the empirical CDF at each bin edge."""
    spark = vectors.sparkSession
    row = _pair_range(vectors, id_col, vec_col).first()  # one aggregate row: the histogram range
    if not row["n"]:
        return spark.createDataFrame([], "bin int, bin_lo double, count long, density double, cdf double")
    lo, hi, total = float(row["vmin"]), float(row["vmax"]), int(row["n"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    hist = pair_stats(vectors, id_col=id_col, vec_col=vec_col, lo=lo, hi=hi, bins=bins, sums=False, ends=False)
    width = (hi - lo) / bins
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows
    return (grid.join(hist.select("bin", "n"), "bin", "left")
            .select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_lo"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("count"))
            .withColumn("density", F.round(F.col("count") / F.lit(float(total * width)), 6))
            .withColumn("cdf", F.round(F.sum("count").over(run) / F.lit(float(total)), 6)))


def pairwise_distribution(vectors: DataFrame, id_col: str, vec_col: str = "embedding", bins: int = 100, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Histogram with fixed bins (cosines: [-1, 1]) and the empirical CDF at each bin's end, in one pass over the pairs:
    ``(bin, bin_lo, count, density, cdf, examined)``; values outside count in the outer bins."""
    hist = pair_stats(vectors, id_col=id_col, vec_col=vec_col, lo=lo, hi=hi, bins=bins, sums=False, ends=False).select("bin", "n", "examined")
    width = (hi - lo) / bins
    grid = vectors.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    every = Window.partitionBy().orderBy("bin")  # `bins` rows
    n = F.coalesce("n", F.lit(0)).cast("long")
    total = F.sum("count").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (grid.join(hist, "bin", "left")
            .select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_lo"), n.alias("count"), F.coalesce("examined", F.lit(0)).cast("long").alias("examined"))
            .withColumn("density", F.round(F.col("count") / (total * F.lit(width)), 6))
            .withColumn("cdf", F.round(F.sum("count").over(every.rowsBetween(Window.unboundedPreceding, 0)) / total, 6)))


def pairwise_cdf(vectors: DataFrame, id_col: str, vec_col: str = "embedding",
                 cuts=(0.85, 0.90, 0.95)) -> DataFrame:
    """Share of all pairs with an inner product >= each cut."""
    mom = _pair_range(vectors, id_col, vec_col, cuts, ends=False)
    rows = [F.struct(F.lit(float(c)).alias("cut"),
                     F.round(F.col(f"n_ge_{j}") / F.col("n"), 6).alias("share_ge")) for j, c in enumerate(cuts)]
    return mom.select(F.inline(F.array(*rows)))


# ------------------------------------------------------------------------------ E8 (assignment)

# Entries of one (rows x centres) or (rows x bits) matrix that a task holds at once.
ROW_ENTRIES = 1_000_000


def row_slices(rows: int, width: int) -> list[slice]:
    """Slices of a batch whose matrix of ``width`` columns has at most ``ROW_ENTRIES`` entries (one row at least)."""
    step = max(1, ROW_ENTRIES // max(width, 1))
    return [slice(at, min(rows, at + step)) for at in range(0, rows, step)]


def assign_nearest(df: DataFrame, centers: np.ndarray, id_col: str = "id", vec_col: str = "embedding",
                   k: int = 1, keep_vector: bool = False) -> DataFrame:
    """For every row the ``k`` nearest centres: ``(<id_col>, rank, cell, dist[, <vec_col>])``.

    The centre matrix is small (cells x dim, a parameter of the index) and broadcast; the
    rows are scanned once with ``mapInArrow`` (no shuffle). ``keep_vector`` carries the
    vector through, so callers need no join back to the source."""
    spark = df.sparkSession
    C = np.asarray(centers, dtype=np.float64)
    bc = spark.sparkContext.broadcast(C)
    kk = min(k, C.shape[0])

    def scan(batches):
        Cm = bc.value
        cn = np.einsum("ij,ij->i", Cm, Cm)
        for b in batches:
            all_ids, all_X = arrow_vectors(b, id_col, vec_col)
            if len(all_ids) == 0:
                continue
            if keep_vector:
                valid = b.column(vec_col).is_valid()
                vec = b.column(vec_col).filter(valid) if valid.false_count else b.column(vec_col)
            for at in row_slices(len(all_ids), len(Cm)):
                ids, X = all_ids[at], all_X[at]
                D = np.einsum("ij,ij->i", X, X)[:, None] + cn[None, :] - 2.0 * (X @ Cm.T)
                np.maximum(D, 0.0, out=D)
                order = np.argsort(D, axis=1, kind="stable")[:, :kk]  # ties: lower centre index
                rows = np.repeat(np.arange(len(ids)), kk)
                cells = order.reshape(-1)
                cols = {
                    id_col: pa.array(ids[rows], pa.int64()),
                    "rank": pa.array(np.tile(np.arange(1, kk + 1), len(ids)).astype(np.int32), pa.int32()),
                    "cell": pa.array(cells.astype(np.int32), pa.int32()),
                    "dist": pa.array(D[rows, cells], pa.float64()),
                }
                if keep_vector:
                    cols[vec_col] = vec.take(pa.array(rows + at.start))
                yield pa.RecordBatch.from_pydict(cols)

    vec_type = df.schema[vec_col].dataType.simpleString()
    schema = f"{id_col} long, rank int, cell int, dist double" + (f", {vec_col} {vec_type}" if keep_vector else "")
    return df.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(scan, schema)


def partial_moments(df: DataFrame, vec_col: str = "embedding", key: str | None = None) -> DataFrame:
    """``(key, n, nsq, norm, s, ss)`` per Arrow batch and key: row count, sum of squared norms, sum of
    norms, and the vectors of sums and of squared sums by dimension. One short row per batch
    and key leaves a task, not one per vector component. ``key`` is a long column (null: 0)."""
    keyed = df.select((F.coalesce(F.col(key).cast("long"), F.lit(0)) if key else F.lit(0).cast("long")).alias("key"), F.col(vec_col).alias("v"))

    def scan(batches):
        for b in batches:
            keys, X = arrow_vectors(b, "key", "v")
            if len(keys) == 0:
                continue
            own, at = np.unique(keys, return_inverse=True)
            sq = X * X
            row = sq.sum(axis=1)
            s, ss = np.zeros((len(own), X.shape[1])), np.zeros((len(own), X.shape[1]))
            np.add.at(s, at, X)
            np.add.at(ss, at, sq)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(own, pa.int64()), "n": pa.array(np.bincount(at), pa.int64()),
                "nsq": pa.array(np.bincount(at, weights=row), pa.float64()), "norm": pa.array(np.bincount(at, weights=np.sqrt(row)), pa.float64()),
                "s": pa.array(list(s), pa.list_(pa.float64())), "ss": pa.array(list(ss), pa.list_(pa.float64()))})

    return keyed.mapInArrow(scan, "key long, n long, nsq double, norm double, s array<double>, ss array<double>")


def dimension_sums(parts: DataFrame, keys=("key",)) -> DataFrame:
    """``(*keys, dim, n, s, ss)``: the partial vectors of ``partial_moments`` added up."""
    both = parts.select(*keys, "n", F.posexplode(F.arrays_zip("s", "ss")).alias("dim", "x"))
    return both.groupBy(*keys, "dim").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.ss").alias("ss"))


def group_centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group of a whole-number column (partial sums per batch, see ``partial_moments``)."""
    per = dimension_sums(partial_moments(df, vec_col, group_col)).select(F.col("key").alias(group_col), "dim", (F.col("s") / F.col("n")).alias("m"))
    return per.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


# Centres are shipped to every task: their number is checked before they are collected.
MAX_CENTRES = 65_536


def collect_centroids(df: DataFrame, group_col: str, vec_col: str = "embedding", max_groups: int = MAX_CENTRES):
    """(group values, centre matrix) of the per-group means, ordered by group; raises when the
    group column has more than ``max_groups`` values (the centres would not be a small table)."""
    rows = group_centroids(df, group_col, vec_col).orderBy(group_col).limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"{group_col} has more than {max_groups} groups; too many centres to broadcast")
    return [r[group_col] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float64)


# ------------------------------------------------------------------------------ F1

def recall_at_k(approx: DataFrame, exact: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Mean over queries of |approx_k ∩ exact_k| / |exact_k| (empty truth -> 1.0), per k."""
    out = None
    for k in ks:
        e = exact.filter(F.col("rank") <= k).select("query_id", "neighbor_id")
        a = approx.filter(F.col("rank") <= k).select("query_id", "neighbor_id", F.lit(1).alias("_m"))
        per_q = (e.join(a, ["query_id", "neighbor_id"], "left")
                 .groupBy("query_id")
                 .agg((F.count("_m") / F.count(F.lit(1))).alias("r")))
        queries = exact.select("query_id").distinct().unionByName(approx.select("query_id").distinct()).distinct()
        per_q = queries.join(per_q, "query_id", "left").select(F.coalesce("r", F.lit(1.0)).alias("r"))
        row = per_q.agg(F.lit(k).alias("k"), F.round(F.avg("r"), 6).alias("recall"),
                        F.count(F.lit(1)).alias("n_queries"))
        out = row if out is None else out.unionByName(row)
    return out


def recall_by_config(approx: DataFrame, exact: DataFrame, config_ids: list, ks=(1, 5, 10),
                     config_col: str = "config", weights: DataFrame | None = None) -> DataFrame:
    """F1 for many approximate results at once: ``approx`` carries ``config_col``; one join
    with the truth and one aggregation give ``(config, k, recall, n_queries)``. Every truth
    query counts for every configuration (a query an index returned nothing for scores 0).
    ``weights`` ``(query_id, w)`` turns the mean into a workload mean (a query drawn w times
    counts w times; undrawn queries count 0)."""
    truth = exact.select("query_id", "neighbor_id", "rank")
    sizes = truth.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"_t{k}") for k in ks])
    hits = (approx.select(config_col, "query_id", "neighbor_id", F.col("rank").alias("_ar"))
            .join(truth, ["query_id", "neighbor_id"])
            .groupBy(config_col, "query_id")
            .agg(*[F.count_if((F.col("rank") <= k) & (F.col("_ar") <= k)).alias(f"_h{k}") for k in ks]))
    # configurations are a short literal list: every truth query is repeated once per configuration
    per_q = sizes.withColumn(config_col, F.explode(F.array(*[F.lit(c) for c in config_ids]))) \
        .join(hits, [config_col, "query_id"], "left")
    rec = [F.when(F.col(f"_t{k}") > 0, F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.col(f"_t{k}"))
           .otherwise(F.lit(1.0)) for k in ks]
    if weights is not None:
        per_q = per_q.join(weights.select("query_id", F.col("w").cast("double").alias("_w")), "query_id")
    else:
        per_q = per_q.withColumn("_w", F.lit(1.0))
    stacked = per_q.select(config_col, "_w", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), r.alias("r"))
                                                               for k, r in zip(ks, rec)])))
    return stacked.groupBy(config_col, "k").agg(
        F.round(F.sum(F.col("r") * F.col("_w")) / F.sum("_w"), 6).alias("recall"),
        F.sum("_w").cast("long").alias("n_queries"))


# ------------------------------------------------------------------------------ F8

def distance_analysis(nn: DataFrame, dist_col: str = "dist") -> DataFrame:
    """One row of moments and exact percentiles of the distances, which are written once for both."""
    from cachelens.operators.quantiles import exact_percentiles
    from cachelens.session import materialize

    d = F.col(dist_col)
    nn = materialize(nn.select(dist_col), "distances")
    base = nn.filter(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(d), 4).alias("mean"), F.round(F.stddev_pop(d), 4).alias("std"),
        F.round(F.min(d), 4).alias("min"), F.round(F.max(d), 4).alias("max"))
    pct = exact_percentiles(nn, d, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return base.crossJoin(pct).select("n", "mean", "std", F.round("median", 4).alias("median"), "min", "max",
                                      *[F.round(p, 4).alias(p) for p in ("p5", "p25", "p75", "p95")])


def distance_histogram(nn: DataFrame, dist_col: str = "dist", bins: int = 20, lo: float = 0.0,
                       hi: float = 2.0) -> DataFrame:
    from cachelens.operators.profiling import equal_width_histogram
    return equal_width_histogram(nn, F.col(dist_col), bins, F.lit(float(lo)), F.lit(float(hi)))


# ------------------------------------------------------------------------------ F17

def workload_diversity(emb: DataFrame, vec_col: str = "embedding", label_col: str | None = "label",
                       n_clusters: int = 10) -> DataFrame:
    """Closed-form mean pair distance (all ordered pairs i != j), normalised diversity, and
    the entropy of the cluster labels (natural log, normalised by ln(k))."""
    parts = partial_moments(emb, vec_col)
    base = parts.agg(F.sum("n").alias("n"), (F.sum("nsq") / F.sum("n")).alias("msq"), (F.sum("norm") / F.sum("n")).alias("mnorm"))
    mean_sq = dimension_sums(parts).agg(F.sum(F.pow(F.col("s") / F.col("n"), 2))).scalar()
    n = F.col("n")
    avg_pair = F.when(n > 1, F.lit(2.0) * n / (n - 1) * (F.col("msq") - mean_sq)).otherwise(F.lit(0.0))
    norm_div = F.when(F.col("mnorm") > 0, F.least(F.lit(1.0), avg_pair / (F.lit(2.0) * F.col("mnorm") * F.col("mnorm")))) \
        .otherwise(F.lit(0.0))
    cols = [n.cast("long").alias("n_queries"), F.round(avg_pair, 4).alias("avg_pairwise_distance"),
            F.round(norm_div, 4).alias("pair_diversity")]
    if label_col:
        counts = emb.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
        tot = F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ent = counts.withColumn("p", F.col("c") / tot) \
            .agg((-F.sum(F.col("p") * F.log(F.col("p")))).alias("h"), F.count(F.lit(1)).alias("used"))
        h = ent.select("h").scalar()
        used = ent.select("used").scalar()
        k = max(2, n_clusters)
        cols += [F.round(h / F.lit(math.log(k)), 4).alias("label_entropy"),
                 F.round(F.exp(h), 2).alias("effective_clusters"),
                 used.cast("long").alias("n_clusters_used")]
    return base.select(*cols)


# ------------------------------------------------------------------------------ F18

def semantic_coverage(stream: DataFrame, cache: DataFrame, q_id: str = "query_id", c_id: str = "cache_id",
                      vec_col: str = "embedding", **strategy) -> DataFrame:
    """Mean nearest distance from every stream row to the cache."""
    nn = knn(stream, cache, 1, q_id=q_id, q_vec=vec_col, d_id=c_id, d_vec=vec_col, **strategy)
    return nn.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("dist"), 6).alias("semantic_coverage_avg_dist"))


# ------------------------------------------------------------------------------ F21

def cache_stats(cache: DataFrame, lookups: DataFrame | None = None, active_col: str = "is_active",
                latency_col: str | None = None) -> DataFrame:
    """Entry counts of the cache table and hit counts of a lookup log (one row per query).

    Every row of the table was inserted once and every inactive one evicted; with ``latency_col``
    the log's mean lookup time is added (``avg_lookup_ms``)."""
    a = F.col(active_col)
    base = cache.agg(F.count(F.lit(1)).alias("total_entries"),
                     F.count_if(a).alias("active_entries"),
                     F.count_if(~a).alias("dead_entries"))
    cols = [F.col("active_entries").alias("size"), "total_entries", "active_entries", "dead_entries"]
    if lookups is not None:
        lk = lookups.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"),
                         *([F.round(F.avg(latency_col), 4).alias("ms")] if latency_col else []))
        cols += [lk.select("n").scalar().alias("total_lookups"), lk.select("h").scalar().alias("total_hits")]
        if latency_col:
            cols.append(lk.select("ms").scalar().alias("avg_lookup_ms"))
    cols += [F.col("total_entries").alias("total_inserts"), F.col("dead_entries").alias("total_evictions")]
    return base.select(*cols)

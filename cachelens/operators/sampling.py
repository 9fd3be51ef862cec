"""Splits, subsets, guards (C4-C11) and workload draws.

Random choices are md5 draws of ``seed:salt:id`` (see :mod:`cachelens.functions.draws`), so a
re-executed task draws the same rows. "First n rows in some order" is answered by a cut-off
key: the n-th smallest key is found once by a range-partitioned numbering of the narrow key
column, and the split is a filter against that scalar, so the wide rows are never shuffled
and no task receives every partition's first n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.draws import md5_order_key, uniform_draw
from cachelens.operators.ordering import dense_ids, running_sum
from cachelens.session import materialize

# Default subset sizes of the query tables, by name.
DEFAULT_SUBSET_SIZES = {"10k": 10_000, "50k": 50_000, "100k": 100_000, "500k": 500_000}


def _order_struct(order) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def first_n_flag(df: DataFrame, order, n: int) -> Column:
    """Boolean column: the row is among the first ``n`` rows in ``order`` (a total order). The cut-off key is
    looked up once and goes into the filter as a literal, so no later job works it out again."""
    key = _order_struct(order)
    if n <= 0:
        return F.lit(False)
    ranked = dense_ids(df.select(key.alias("_k")), ["_k"], out_col="_r")
    cut = ranked.filter(F.col("_r") < n).agg(F.max("_k").alias("_k"))
    last = cut.first()["_k"]
    if last is None:
        return F.lit(False)
    literal = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, cut.schema["_k"].dataType.fields)])
    return F.coalesce(key <= literal, F.lit(False))


def random_order(seed: int, salt: str, id_col: str) -> list:
    return [md5_order_key(seed, salt, id_col), F.col(id_col)]


# ---------------------------------------------------------------------------------- C6

def holdout_split(df: DataFrame, id_col: str = "vec_id", query_count: int = 1000,
                  seed: int = 42, salt: str = "holdout") -> DataFrame:
    """``split`` = 'query' for ``min(query_count, N // 5)`` md5-random rows, else 'database'."""
    n = df.count()
    q = min(query_count, n // 5)
    flag = first_n_flag(df, random_order(seed, salt, id_col), q)
    return df.withColumn("split", F.when(flag, F.lit("query")).otherwise(F.lit("database")))


# ---------------------------------------------------------------------------------- C7

def fill_split(df: DataFrame, id_col: str = "vec_id", ratio: float = 0.5, strategy: str = "random",
               seed: int = 42, freq_col: str = "frequency") -> DataFrame:
    """``part`` = 'cache' for ``int(n * ratio)`` rows chosen by ``strategy``, else 'eval'.

    random: md5 order; frequency: highest frequency first (ties: id asc);
    chronological: first rows by id."""
    n = df.count()
    n_cache = int(n * ratio)
    if strategy == "frequency":
        order = [(-F.coalesce(F.col(freq_col), F.lit(1)).cast("double")), F.col(id_col)]
    elif strategy == "chronological":
        order = [F.col(id_col)]
    elif strategy == "random":
        order = random_order(seed, "fill", id_col)
    else:
        raise ValueError(f"unknown fill strategy {strategy!r}; use random, frequency or chronological")
    flag = first_n_flag(df, order, n_cache)
    return df.withColumn("part", F.when(flag, F.lit("cache")).otherwise(F.lit("eval")))


# ---------------------------------------------------------------------------------- C8

def calibration_split(df: DataFrame, id_col: str = "query_id", ratio: float = 0.2,
                      seed: int = 42) -> DataFrame:
    """``role`` = 'calibration' for ``max(10, int(n * ratio))`` random rows, else 'test' (seed + 1)."""
    n = df.count()
    n_cal = max(10, int(n * ratio))
    flag = first_n_flag(df, random_order(seed + 1, "calibration", id_col), n_cal)
    return df.withColumn("role", F.when(flag, F.lit("calibration")).otherwise(F.lit("test")))


# ---------------------------------------------------------------------------------- C9

def warmup_split(df: DataFrame, seq_col: str = "seq", warmup_pct: float = 0.30,
                 cache_pct: float = 0.10) -> DataFrame:
    """``phase``: 'warmup' for the first ``min(int(n*warmup_pct), int(n*cache_pct))`` rows,
    'stream' from ``int(n*warmup_pct)`` on; rows in between belong to neither (null)."""
    n = df.select(F.count(F.lit(1))).scalar()
    n_warm = F.floor(n * F.lit(warmup_pct))
    n_cache = F.floor(n * F.lit(cache_pct))
    s = F.col(seq_col)
    return df.withColumn("phase", F.when(s < F.least(n_warm, n_cache), F.lit("warmup"))
                         .when(s >= n_warm, F.lit("stream")))


# ---------------------------------------------------------------------------------- C4, C5

def fixed_subsets(df: DataFrame, id_col: str = "doc_id", sizes: dict | None = None,
                  seed: int = 42, out_id: str = "query_id") -> DataFrame:
    """Exact-size samples without replacement for every size <= n (ascending), plus ``full``.

    Each subset keeps the original order and is renumbered from 0; a column ``subset``
    names it. The input is run once for its ids; one numbering by (subset, md5 key) draws all
    samples and one by (subset, id) renumbers them; other columns are joined back by id."""
    sizes = DEFAULT_SUBSET_SIZES if sizes is None else sizes
    keys = materialize(df.select(id_col), "subset-ids")
    n = keys.count()
    wanted = [(name, size) for name, size in sizes.items() if size <= n]
    chosen = keys.withColumn("subset", F.lit("full"))
    if wanted:
        draws = F.array(*[F.struct(F.lit(name).alias("subset"), F.lit(size).cast("long").alias("_size"),
                                   md5_order_key(seed, f"subset:{name}", id_col).alias("_key"))
                          for name, size in wanted])
        drawn = keys.select(id_col, F.explode(draws).alias("_d")).select(id_col, "_d.*")
        ranked = dense_ids(drawn, ["_key", id_col], out_col="_rank", partition_by=["subset"])
        chosen = chosen.unionByName(ranked.filter(F.col("_rank") < F.col("_size")).select(id_col, "subset"))
    new_id = out_id if out_id != id_col else "_new_id"
    numbered = dense_ids(chosen, [id_col], out_col=new_id, partition_by=["subset"])
    others = [c for c in df.columns if c not in (id_col, new_id)]
    return numbered.join(df.select(id_col, *others), id_col) if others else numbered


def embedding_subsets(embeddings: DataFrame, subsets: DataFrame, emb_id: str = "vec_id",
                      subset_id: str = "doc_id") -> DataFrame:
    """The vectors of each subset: a semi join on the original row id (alignment by key)."""
    keys = subsets.select(F.col(subset_id).alias(emb_id), "subset", "query_id")
    return embeddings.join(keys, emb_id, "inner")


# ---------------------------------------------------------------------------------- C10, C11

def leakage_count(queries: DataFrame, database: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row: number of query ids that are also database ids (must be 0)."""
    shared = queries.select(id_col).join(database.select(id_col), id_col, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("n_leaked"))


def row_expectations(df: DataFrame, label_col: str = "dataset_label", workload_col: str = "workload",
                     min_full_scale: int = 500_000) -> DataFrame:
    """Per label: rows, rows without workload, and whether a ``full`` label meets its scale."""
    return (df.groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col(workload_col).isNull()).alias("n_missing_workload"))
            .withColumn("scale_ok", ~F.col(label_col).contains("full") | (F.col("n_rows") >= min_full_scale))
            .withColumn("ok", (F.col("n_missing_workload") == 0) & F.col("scale_ok")))


# ---------------------------------------------------------------------------------- D1-D5

def _draw_table(spark, n: int, seed: int, salt: str):
    return spark.range(n).withColumnRenamed("id", "draw_id") \
        .withColumn("u", uniform_draw(seed, salt, "draw_id"))


def sample_uniform(rows: DataFrame, n: int, seed: int = 42, id_col: str = "query_id") -> DataFrame:
    """``n`` draws with replacement, each row equally likely: ``(draw_id, <id_col>)``.

    ``rows`` must carry dense ids 0..Q-1 in ``id_col``; the draw is an equi join on the
    drawn position, so nothing is collected."""
    spark = rows.sparkSession
    q = rows.select(F.count(F.lit(1))).scalar()
    draws = _draw_table(spark, n, seed, "uniform").withColumn(
        "_pos", F.floor(F.col("u") * q).cast("long"))
    return draws.join(rows.select(F.col(id_col).alias("_pos"), F.col(id_col)), "_pos") \
        .select("draw_id", id_col)


def cluster_weights(rows: DataFrame, cluster_col: str = "label", exponent: float = 1.0) -> DataFrame:
    """Non-empty clusters in id order get rank r and weight ``r^-exponent`` normalised,
    with cumulative ``[lo, hi)`` bounds for the range join of a uniform draw. Ranks and the
    cumulative sum use range-partitioned numbering / prefix sums (no global window)."""
    sizes = rows.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    ranked = dense_ids(sizes, [cluster_col], out_col="r", start=1) \
        .withColumn("w", F.pow(F.col("r").cast("double"), F.lit(-float(exponent))))
    total = ranked.agg(F.sum("w")).scalar()
    weighted = ranked.withColumn("p", F.col("w") / total)
    return running_sum(weighted, ["r"], "p", "hi", inclusive=True).withColumn("lo", F.col("hi") - F.col("p"))


# Buckets of the unit interval used to turn the range join into an equi join.
RANGE_BUCKETS = 1 << 16


def range_pick(draws: DataFrame, intervals: DataFrame, u_col: str = "u") -> DataFrame:
    """Join each draw (``draw_id`` is unique) to the interval ``[lo, hi)`` containing ``u`` (the last interval also takes
    ``u`` up to 1). The unit interval is cut into fixed buckets; an interval is repeated once per
    bucket it overlaps (clusters + buckets rows in total), so the range join becomes an equi join
    on the bucket plus a filter, and no side has to be broadcast."""
    b = F.lit(RANGE_BUCKETS)
    iv = (intervals
          .withColumn("_b0", F.floor(F.col("lo") * b).cast("long"))
          .withColumn("_b1", F.least(F.floor(F.col("hi") * b).cast("long"), b - 1))
          .withColumn("_bucket", F.explode(F.sequence(F.col("_b0"), F.greatest(F.col("_b0"), F.col("_b1"))))))
    d = draws.withColumn("_bucket", F.least(F.floor(F.col(u_col) * b).cast("long"), b - 1))
    top = intervals.agg(F.max("hi")).scalar()
    inside = (F.col(u_col) >= F.col("lo")) & ((F.col(u_col) < F.col("hi")) | (F.col("hi") >= top))
    # a u on an interval edge may match two intervals through rounding: keep the lower one
    w = Window.partitionBy("draw_id").orderBy("lo")
    return (d.join(iv, "_bucket").filter(inside)
            .withColumn("_one", F.row_number().over(w)).filter("_one = 1")
            .drop("_bucket", "_b0", "_b1", "_one"))


def _members(rows: DataFrame, cluster_col: str, id_col: str) -> DataFrame:
    """Member number 0..size-1 inside each cluster (skew-safe: a hot cluster is range-split)."""
    return dense_ids(rows.select(cluster_col, id_col), [id_col], out_col="_m", partition_by=[cluster_col])


def sample_zipf_clusters(rows: DataFrame, n: int, seed: int = 42, cluster_col: str = "label",
                         id_col: str = "query_id", exponent: float = 1.0) -> DataFrame:
    """Draw a cluster with Zipf weights (range join of u1 on the cumulative bounds), then a
    member uniformly (u2): ``(draw_id, <cluster_col>, <id_col>)``."""
    spark = rows.sparkSession
    weights = cluster_weights(rows, cluster_col, exponent)
    d = _draw_table(spark, n, seed, "zipf").withColumn("u2", uniform_draw(seed, "member", "draw_id"))
    picked = range_pick(d, weights.select(cluster_col, "lo", "hi", "size"))
    picked = picked.withColumn("_m", F.floor(F.col("u2") * F.col("size")).cast("long"))
    return picked.join(_members(rows, cluster_col, id_col), [cluster_col, "_m"]) \
        .select("draw_id", cluster_col, id_col)


def sample_concentrated(rows: DataFrame, n: int, gamma: float, seed: int = 42,
                        cluster_col: str = "label", id_col: str = "query_id") -> DataFrame:
    """gamma <= 0.001: uniform; else Zipf over the rows' own clusters with exponent 1 + 3*gamma."""
    if gamma <= 0.001:
        out = sample_uniform(rows, n, seed, id_col)
        return out.join(rows.select(id_col, cluster_col), id_col).select("draw_id", cluster_col, id_col)
    return sample_zipf_clusters(rows, n, seed, cluster_col, id_col, exponent=1.0 + 3.0 * gamma)


def sample_bursty(rows: DataFrame, n: int, seed: int = 42, cluster_col: str = "label",
                  id_col: str = "query_id", mean_burst: int = 20) -> DataFrame:
    """Bursts of geometric length (mean ``mean_burst``) from uniformly chosen clusters, members
    drawn with replacement, cut at ``n`` draws: ``(draw_id, burst_id, <cluster_col>, <id_col>)``.

    At most ``n`` bursts are needed (each has length >= 1); their start positions come from a
    running sum, and ``explode(sequence(..))`` expands them."""
    spark = rows.sparkSession
    p = 1.0 / mean_burst
    clusters = rows.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    k = clusters.select(F.count(F.lit(1))).scalar()
    cl = dense_ids(clusters, [cluster_col], out_col="_c")
    bursts = (spark.range(n).withColumnRenamed("id", "burst_id")
              .withColumn("_uc", uniform_draw(seed, "burst_cluster", "burst_id"))
              .withColumn("_ul", uniform_draw(seed, "burst_len", "burst_id"))
              .withColumn("_c", F.floor(F.col("_uc") * k).cast("long"))
              .withColumn("len", F.greatest(F.lit(1), F.ceil(F.log(F.lit(1.0) - F.col("_ul")) / math.log(1.0 - p))).cast("long")))
    # start of each burst: exclusive running sum of lengths in burst order
    bursts = running_sum(bursts, ["burst_id"], "len", "start")
    bursts = bursts.filter(F.col("start") < n)
    draws = (bursts.join(cl.select("_c", cluster_col, "size"), "_c")
             .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
             .withColumn("draw_id", F.col("start") + F.col("_i"))
             .filter(F.col("draw_id") < n)
             .withColumn("_u", uniform_draw(seed, "burst_member", "draw_id"))
             .withColumn("_m", F.floor(F.col("_u") * F.col("size")).cast("long")))
    return draws.join(_members(rows, cluster_col, id_col), [cluster_col, "_m"]) \
        .select("draw_id", "burst_id", cluster_col, id_col)


def reorder_stream(rows: DataFrame, workload: str, seed: int = 42, id_col: str = "query_id",
                   seq_col: str = "seq", cluster_col: str = "label") -> DataFrame:
    """temporal = unchanged; uniform/clustered/bursty = a draw of the same length whose
    ``draw_id`` becomes the new ``seq``."""
    if workload == "temporal":
        return rows
    n = rows.count()
    if workload == "uniform":
        draws = sample_uniform(rows, n, seed, id_col)
    elif workload == "clustered":
        draws = sample_zipf_clusters(rows, n, seed, cluster_col, id_col)
    elif workload == "bursty":
        draws = sample_bursty(rows, n, seed, cluster_col, id_col)
    else:
        raise ValueError(f"unknown workload {workload!r}; use temporal, uniform, clustered or bursty")
    body = rows.drop(seq_col) if seq_col in rows.columns else rows
    return draws.select("draw_id", id_col).join(body, id_col).withColumnRenamed("draw_id", seq_col)

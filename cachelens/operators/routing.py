"""Similarity-threshold routing analytics.

Input is a *nearest-neighbour table*: one row per query with the distance to its nearest
cache entry (``dist``), its id (``nn_id``) and, for quality metrics, the exact nearest
distance and id (``gt_dist``, ``gt_id``). A missing neighbour is ``dist = null``
(treated as +inf: never a hit).

Threshold sweeps never replicate rows per threshold: each row is bucketed once by the
smallest threshold that accepts it, buckets are aggregated (map-side partial aggregation),
and the per-threshold figures are running sums over the few bucket rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.cost import CostModel
from cachelens.functions.vector import cosine_quality

# Default sweep thresholds of the routing evaluation.
DEFAULT_THRESHOLDS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5]
# LLM latencies (ms) of the sensitivity table.
SENSITIVITY_LATENCIES_MS = [200.0, 500.0, 1000.0, 2000.0, 5000.0]
# The routing evaluation uses a constant cache latency.
EVAL_CACHE_LATENCY_MS = 0.5


def linspace(start: float, stop: float, num: int) -> list[float]:
    """Same values as numpy.linspace (step added to start; the end point exact)."""
    if num == 1:
        return [float(start)]
    step = (stop - start) / (num - 1)
    vals = [start + i * step for i in range(num)]
    vals[-1] = float(stop)
    return vals


CALIBRATION_THRESHOLDS = linspace(0.05, 1.5, 50)


def _lit_d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


# ------------------------------------------------------------------------------ B8

def route(nn: DataFrame, threshold: float, dist_col: str = "dist", id_col: str = "nn_id",
          max_distance: float = 2.0) -> DataFrame:
    """Per query: action cache/llm (inclusive threshold), confidence, cache index (-1 on miss)."""
    d = F.coalesce(F.col(dist_col).cast("double"), F.lit(float("inf")))
    hit = d <= _lit_d(threshold)
    return nn.select(
        "*",
        F.when(hit, F.lit("cache")).otherwise(F.lit("llm")).alias("action"),
        F.greatest(F.lit(0.0), F.lit(1.0) - d / F.lit(float(max_distance))).alias("confidence"),
        F.when(hit, F.col(id_col)).otherwise(F.lit(-1)).cast("long").alias("cache_index"),
        F.lit(float(threshold)).alias("threshold"),
    )


# ------------------------------------------------------------------------------ F9

def router_stats(routed: DataFrame, dist_col: str = "dist") -> DataFrame:
    """Counts, hit rate and distance statistics of a routed stream. Its two columns are written once, so
    that the search behind them does not run for the moments and for the median."""
    from cachelens.operators.quantiles import exact_percentiles
    from cachelens.session import materialize

    routed = materialize(routed.select("action", dist_col), "routed")
    hits = F.count_if(F.col("action") == "cache")
    n = F.count(F.lit(1))
    d = F.col(dist_col)
    median = exact_percentiles(routed, d, {"median": 0.5}).select("median").scalar()
    return routed.agg(
        n.alias("total_queries"), hits.alias("cache_hits"), (n - hits).alias("llm_calls"),
        F.round(F.when(n > 0, hits / n).otherwise(0.0), 4).alias("hit_rate"),
        F.round(F.avg(d), 4).alias("avg_distance"),
        F.round(F.min(d), 4).alias("min_distance"),
        F.round(F.max(d), 4).alias("max_distance"),
    ).select("total_queries", "cache_hits", "llm_calls", "hit_rate", "avg_distance",
             F.round(median, 4).alias("median_distance"), "min_distance", "max_distance")


# ------------------------------------------------------------------------------ B9

def routing_cost(routed: DataFrame, cost: CostModel = CostModel()) -> DataFrame:
    """Total and mean routed cost against always calling the model."""
    c = cost.routing_cost(F.col("action") == "cache")
    return routed.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.sum(c), 6).alias("total_cost"),
        F.round(F.avg(c), 6).alias("avg_cost"),
        F.round(F.count(F.lit(1)) * cost.direct_llm_cost(), 6).alias("direct_llm_total_cost"),
    )


# ------------------------------------------------------------------------------ F5, F4

def _bucket(d: Column, thresholds: list[float]) -> Column:
    expr = None
    for j, t in enumerate(thresholds):
        cond = d <= _lit_d(t)
        expr = F.when(cond, F.lit(j)) if expr is None else expr.when(cond, F.lit(j))
    return expr.otherwise(F.lit(len(thresholds)))


def _threshold_table(spark, thresholds: list[float]) -> DataFrame:
    return spark.createDataFrame([(j, float(t)) for j, t in enumerate(thresholds)],
                                 "j int, threshold double")


def sweep_counts(nn: DataFrame, thresholds: list[float], dist_col: str = "dist",
                 id_col: str | None = "nn_id", gt_dist_col: str | None = "gt_dist",
                 gt_id_col: str | None = "gt_id") -> DataFrame:
    """Per threshold: n, n_hits and the sums behind the hit-quality metrics (unrounded)."""
    thresholds = sorted(float(t) for t in thresholds)
    d = F.col(dist_col).cast("double")
    q = cosine_quality(d)
    same = (F.col(id_col) == F.col(gt_id_col)).cast("long") if id_col and gt_id_col else F.lit(1)
    dq = (d <= F.col(gt_dist_col) * 2.0 + 0.01).cast("long") if gt_dist_col else F.lit(1)
    per_bucket = (nn.select(F.when(d.isNull(), F.lit(len(thresholds))).otherwise(_bucket(d, thresholds)).alias("j"),
                            q.alias("q"), same.alias("same"), dq.alias("dq"))
                  .groupBy("j")
                  .agg(F.count(F.lit(1)).alias("c"), F.sum("q").alias("sq"),
                       F.sum("same").alias("ss"), F.sum("dq").alias("sd")))
    # every bucket (including "no threshold accepts it") in one small table: the total is a
    # window sum over it, so the distance input is evaluated once (no scalar re-evaluation)
    t = _threshold_table(nn.sparkSession, thresholds)
    full = t.join(per_bucket, "j", "full")
    run = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)  # <= len(thresholds) + 1 rows
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (full.select("j", "threshold",
                        F.coalesce(F.sum("c").over(run), F.lit(0)).alias("n_hits"),
                        F.coalesce(F.sum("sq").over(run), F.lit(0.0)).alias("sum_quality"),
                        F.coalesce(F.sum("ss").over(run), F.lit(0)).alias("sum_same"),
                        F.coalesce(F.sum("sd").over(run), F.lit(0)).alias("sum_dq"),
                        F.coalesce(F.sum("c").over(every), F.lit(0)).alias("n"))
            .filter(F.col("threshold").isNotNull()))


def _ratio_or_one(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def threshold_sweep(nn: DataFrame, thresholds: list[float] = DEFAULT_THRESHOLDS,
                    cost: CostModel = CostModel(cache_latency_ms=EVAL_CACHE_LATENCY_MS),
                    **cols) -> DataFrame:
    """for each threshold hit rate, hit quality (F4), hits, misses and savings."""
    s = sweep_counts(nn, thresholds, **cols)
    h = F.when(F.col("n") > 0, F.col("n_hits") / F.col("n")).otherwise(F.lit(0.0))
    return s.select(
        F.round("threshold", 4).alias("threshold"),
        F.round(h, 4).alias("hit_rate"),
        F.round(_ratio_or_one(F.col("sum_quality"), F.col("n_hits")), 4).alias("retrieval_similarity"),
        F.round(_ratio_or_one(F.col("sum_same"), F.col("n_hits")), 4).alias("recall_at_1"),
        F.round(_ratio_or_one(F.col("sum_dq"), F.col("n_hits")), 4).alias("distance_quality"),
        F.col("n_hits").cast("long").alias("n_hits"),
        (F.col("n") - F.col("n_hits")).cast("long").alias("n_misses"),
        F.round(cost.avg_latency(h), 6).alias("avg_latency_ms"),
        cost.latency_saving_pct(h).alias("latency_saving_pct"),
        F.round(cost.avg_cost_usd(h), 8).alias("avg_cost_usd"),
        cost.monetary_saving_pct(h).alias("monetary_saving_pct"),
    )


def hit_quality(nn: DataFrame, threshold: float, **cols) -> DataFrame:
    """F4 at one threshold."""
    sw = threshold_sweep(nn, [threshold], **cols)
    return sw.select("threshold", "n_hits", "retrieval_similarity", "recall_at_1", "distance_quality")


# ------------------------------------------------------------------------------ F6

def calibrate_threshold(nn: DataFrame, thresholds: list[float] = CALIBRATION_THRESHOLDS,
                        min_quality: float = 0.8,
                        cost: CostModel = CostModel(cache_latency_ms=EVAL_CACHE_LATENCY_MS),
                        dist_col: str = "dist") -> DataFrame:
    """Every threshold with its objective; ``chosen`` marks the calibrated one.

    quality = mean cosine over hits (1.0 without hits, unrounded); feasible iff
    quality >= min_quality; objective = latency% + monetary% - 200 * (1 - quality) with
    the 2-digit savings; highest objective wins, the smallest threshold on ties; when no
    threshold is feasible the first one is chosen."""
    s = sweep_counts(nn, thresholds, dist_col=dist_col, id_col=None, gt_dist_col=None, gt_id_col=None)
    h = F.when(F.col("n") > 0, F.col("n_hits") / F.col("n")).otherwise(F.lit(0.0))
    quality = _ratio_or_one(F.col("sum_quality"), F.col("n_hits"))
    scored = s.select(
        "j", "threshold", h.alias("hit_rate"), quality.alias("quality"),
        F.col("n_hits").cast("long").alias("n_hits"),
        (F.col("n") - F.col("n_hits")).cast("long").alias("n_misses"),
        cost.latency_saving_pct(h).alias("latency_saving_pct"),
        cost.monetary_saving_pct(h).alias("monetary_saving_pct"))
    scored = scored.withColumn("feasible", F.col("quality") >= F.lit(float(min_quality))) \
        .withColumn("objective", F.when(F.col("feasible"),
                                        F.col("latency_saving_pct") + F.col("monetary_saving_pct")
                                        - F.lit(2.0) * (F.lit(1.0) - F.col("quality")) * F.lit(100.0)))
    # one row per threshold (<= a few dozen): a global window here is small by construction
    best = Window.orderBy(F.col("feasible").desc(), F.col("objective").desc_nulls_last(), F.col("j"))
    return (scored.withColumn("_r", F.row_number().over(best))
            .select(F.round("threshold", 4).alias("threshold"), F.round("hit_rate", 4).alias("hit_rate"),
                    F.round("quality", 4).alias("quality"), "n_hits", "n_misses",
                    "latency_saving_pct", "monetary_saving_pct",
                    F.round("objective", 4).alias("objective"),
                    (F.col("_r") == 1).alias("chosen"),
                    F.col("threshold").alias("_t_exact")))


def chosen_threshold(calibration: DataFrame) -> Column:
    """Scalar column with the calibrated (unrounded) threshold."""
    return calibration.filter("chosen").agg(F.max("_t_exact")).scalar()


# ------------------------------------------------------------------------------ F7

def adaptive_routing(nn: DataFrame, calibration_ratio: float = 0.2, min_quality: float = 0.8,
                     seed: int = 42, thresholds: list[float] = CALIBRATION_THRESHOLDS,
                     cost: CostModel = CostModel(cache_latency_ms=EVAL_CACHE_LATENCY_MS),
                     id_col: str = "query_id", **cols) -> DataFrame:
    """Calibrate on a random part, report hit rate, quality and savings on the rest."""
    from cachelens.operators.sampling import calibration_split
    from cachelens.session import materialize

    # the nearest-neighbour table feeds a count, the calibration and the test aggregate:
    # cut its lineage once instead of re-running the search for each
    nn = materialize(nn, "nn")
    parts = calibration_split(nn, id_col=id_col, ratio=calibration_ratio, seed=seed)
    cal = parts.filter(F.col("role") == "calibration")
    test = parts.filter(F.col("role") == "test")
    t = chosen_threshold(calibrate_threshold(cal, thresholds, min_quality, cost, cols.get("dist_col", "dist")))
    dist_col = cols.get("dist_col", "dist")
    d = F.col(dist_col).cast("double")
    hit = F.coalesce(d <= t, F.lit(False))
    id_c, gt_d, gt_i = cols.get("id_col_nn", "nn_id"), cols.get("gt_dist_col", "gt_dist"), cols.get("gt_id_col", "gt_id")
    n_cal = cal.select(F.count(F.lit(1))).scalar()
    agg = test.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("n_hits"),
        F.sum(F.when(hit, cosine_quality(d))).alias("sq"),
        F.count_if(hit & (F.col(id_c) == F.col(gt_i))).alias("ss"),
        F.count_if(hit & (d <= F.col(gt_d) * 2.0 + 0.01)).alias("sd"))
    h = F.when(F.col("n") > 0, F.col("n_hits") / F.col("n")).otherwise(F.lit(0.0))
    return agg.select(
        F.round(t, 4).alias("best_threshold"),
        n_cal.cast("long").alias("calibration_size"),
        F.col("n").alias("test_size"),
        F.round(h, 4).alias("test_hit_rate"),
        F.round(_ratio_or_one(F.col("sq"), F.col("n_hits")), 4).alias("retrieval_similarity"),
        F.round(_ratio_or_one(F.col("ss"), F.col("n_hits")), 4).alias("recall_at_1"),
        F.round(_ratio_or_one(F.col("sd"), F.col("n_hits")), 4).alias("distance_quality"),
        cost.latency_saving_pct(h).alias("latency_saving_pct"),
        cost.monetary_saving_pct(h).alias("monetary_saving_pct"))


# ------------------------------------------------------------------------------ B10, F11

def cost_savings(hit_rates: DataFrame, hit_col: str = "hit_rate", cost: CostModel = CostModel()) -> DataFrame:
    h = F.col(hit_col).cast("double")
    return hit_rates.select("*", *cost.savings_columns(h))


def latency_sensitivity(hit_rate_row: DataFrame, hit_col: str = "hit_rate",
                        latencies_ms: list[float] = SENSITIVITY_LATENCIES_MS,
                        cache_latency_ms: float = 0.5) -> DataFrame:
    """For each LLM latency: effective latency and saving at the measured hit rate."""
    h = F.col(hit_col).cast("double")
    rows = []
    for L in latencies_ms:
        cm = CostModel(llm_latency_ms=L, cache_latency_ms=cache_latency_ms)
        rows.append(F.struct(F.lit(float(L)).alias("llm_latency_ms"),
                             F.round(cm.avg_latency(h), 6).alias("effective_latency_ms"),
                             cm.latency_saving_pct(h).alias("latency_saving_pct")))
    return hit_rate_row.select(F.round(h, 4).alias("hit_rate"), F.inline(F.array(*rows)))


# ------------------------------------------------------------------------------ F15

def best_fixed_threshold(sweeps: DataFrame, group_col: str = "strategy",
                         metric: str = "latency_saving_pct") -> DataFrame:
    """Sweep row with the highest ``metric`` per group (first threshold wins ties)."""
    # a sweep table has one row per (group, threshold): small by construction
    w = Window.partitionBy(group_col).orderBy(F.col(metric).desc(), F.col("threshold"))
    return sweeps.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

"""Result-table analytics (I1-I13, F19, F20): best rows, Pareto fronts, run summaries,
completeness, checkpoint bands, matrices, gaps, sweep series and hit-rate windows.

Ordered computations over whole tables (running max, cumulative and rolling rates) use the
range-partitioned prefix aggregates of :mod:`cachelens.operators.ordering`, so neither a
global order nor one hot stream lands in a single task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.operators.ordering import dense_ids, previous_value, running_sum


# ------------------------------------------------------------------------------ I1

def best_per_group(df: DataFrame, group_col: str, metric: str, pos_col: str, scale_col: str | None = None) -> DataFrame:
    """Row with the highest ``metric`` per group (first position wins ties); with
    ``scale_col`` only rows of the largest scale are considered."""
    if scale_col:
        top = df.agg(F.max(scale_col)).scalar()
        df = df.filter(F.col(scale_col) == top)
    # an aggregate, not a window: max(struct(metric, -position, row)) is combined map-side,
    # so a group holding a large share of the rows is not sorted in one task
    others = [c for c in df.columns if c != group_col]
    best = F.max(F.struct(F.col(metric).alias("_m"), (-F.col(pos_col)).alias("_p"),
                          *[F.col(c).alias(c) for c in others]))
    return df.groupBy(group_col).agg(best.alias("_b")).select(group_col, *[F.col(f"_b.{c}").alias(c) for c in others])


# ------------------------------------------------------------------------------ I2, I3, I4

def pareto_min_max(df: DataFrame, x: str, y: str, pos_col: str) -> DataFrame:
    """Sorted by x (stable: input position), keep rows whose y is a strict new maximum (> -1)."""
    pm = running_sum(df, [x, pos_col], y, "_prev_max", agg="max")
    return pm.filter(F.col(y) > F.greatest(F.coalesce("_prev_max", F.lit(-1.0)), F.lit(-1.0))).drop("_prev_max")


def pareto_nonstrict(df: DataFrame, x: str, y: str, pos_col: str) -> DataFrame:
    """Sorted by x, keep the first row, then rows with y >= the last kept y (= running max)."""
    pm = running_sum(df, [x, pos_col], y, "_prev_max", agg="max")
    return pm.filter(F.col("_prev_max").isNull() | (F.col(y) >= F.col("_prev_max"))).drop("_prev_max")


def pareto_nondominated(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows not dominated in (max x, max y); equal duplicates all stay.

    Keep iff y is the maximum of its x and exceeds the maximum y over all larger x (a
    suffix maximum over the distinct x values, joined back on x)."""
    per_x = df.groupBy(x).agg(F.max(y).alias("_ymax"))
    suffix = running_sum(per_x.withColumn("_negx", -F.col(x)), ["_negx"], "_ymax", "_ymax_larger", agg="max") \
        .select(x, "_ymax", "_ymax_larger")
    return (df.join(suffix, x)
            .filter((F.col(y) == F.col("_ymax")) & (F.col("_ymax_larger").isNull() | (F.col(y) > F.col("_ymax_larger"))))
            .drop("_ymax", "_ymax_larger"))


# ------------------------------------------------------------------------------ runs

def hit_flags(events: DataFrame, gap: int = 100) -> DataFrame:
    """Access log with ``seq`` and ``hit``: the key was touched at most ``gap`` positions before."""
    from cachelens.operators.retention import access_log

    log = access_log(events, keep=[c for c in ("event_type", "value") if c in events.columns])
    prev = previous_value(log, ["key"], ["seq"], "seq", "_prev")
    return prev.withColumn("hit", F.coalesce((F.col("seq") - F.col("_prev")) <= gap, F.lit(False))).drop("_prev")


def runs_from_events(events: DataFrame) -> DataFrame:
    """The documented derivation of policy runs from the event log (one row per run)."""
    flagged = hit_flags(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return (flagged.groupBy(F.col("event_type").alias("policy"),
                            ((F.col("key") % 3 + 1) / 10.0).alias("cache_size_pct"),
                            (F.col("event_id") % 3).alias("seed"),
                            ((F.col("event_id") % 5) / 4.0).alias("gamma"))
            .agg(F.avg(F.col("hit").cast("double")).alias("final_hit_rate"),
                 F.avg("value").alias("semantic_coverage_avg_dist"),
                 F.count(F.lit(1)).alias("n_queries"),
                 ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("stream_time_s"),
                 F.count_if(~F.col("hit")).alias("n_evictions"),
                 (F.count_distinct("key") / F.count(F.lit(1))).alias("diversity"))
            .withColumn("workload", F.lit("temporal")))


def runs_summary(runs: DataFrame, by_gamma: bool = False) -> DataFrame:
    """per (policy, size[, gamma], workload) mean/std(pop) of hit rate and coverage, mean
    stream time, evictions and diversity."""
    keys = (["gamma"] if by_gamma else []) + ["policy", "cache_size_pct", "workload"]
    ok = runs.filter(F.col("error").isNull()) if "error" in runs.columns else runs
    return ok.groupBy(*keys).agg(
        F.round(F.avg("final_hit_rate"), 6).alias("hit_rate_mean"),
        F.round(F.stddev_pop("final_hit_rate"), 6).alias("hit_rate_std"),
        F.round(F.avg("semantic_coverage_avg_dist"), 6).alias("coverage_mean"),
        F.round(F.stddev_pop("semantic_coverage_avg_dist"), 6).alias("coverage_std"),
        F.round(F.avg("stream_time_s"), 3).alias("stream_time_mean_s"),
        F.round(F.avg("n_evictions"), 1).alias("evictions_mean"),
        F.round(F.avg("diversity"), 6).alias("diversity_mean"),
        F.count(F.lit(1)).alias("n_runs"))


def dominance_check(summary: DataFrame, baseline: str, by_gamma: bool = False, tol: float = 0.001) -> DataFrame:
    """groups where the baseline's mean hit rate is below another policy's by > tol."""
    keys = (["gamma"] if by_gamma else []) + ["cache_size_pct", "workload"]
    base = summary.filter(F.col("policy") == baseline).select(*keys, F.col("hit_rate_mean").alias("baseline_mean"))
    other = summary.filter(F.col("policy") != baseline).select(*keys, "policy", F.col("hit_rate_mean").alias("policy_mean"))
    return (base.join(other, keys)
            .filter(F.col("baseline_mean") < F.col("policy_mean") - tol)
            .withColumn("gap", F.round(F.col("policy_mean") - F.col("baseline_mean"), 6)))


def matrix_completeness(runs: DataFrame, policies: list, sizes: list, seeds_required: int) -> DataFrame:
    """Every required (policy, size) cell with its run count; absent or short ones flagged."""
    spark = runs.sparkSession
    cells = spark.createDataFrame([(p, float(s)) for p, s in itertools.product(policies, sizes)],
                                  "policy string, cache_size_pct double")
    counts = runs.groupBy("policy", "cache_size_pct").agg(F.count(F.lit(1)).alias("n_runs"))
    return (cells.join(counts, ["policy", "cache_size_pct"], "left")
            .withColumn("n_runs", F.coalesce("n_runs", F.lit(0)).cast("long"))
            .withColumn("status", F.when(F.col("n_runs") == 0, F.lit("missing"))
                        .when(F.col("n_runs") < seeds_required, F.lit("incomplete")).otherwise(F.lit("ok"))))


def policy_matrix(summary: DataFrame, sizes: list, mean: str = "hit_rate_mean", std: str = "hit_rate_std") -> DataFrame:
    """Policy x size matrix of mean and std (missing = 0)."""
    cells = []
    for s in sizes:
        here, name = F.col("cache_size_pct") == float(s), f"size_{int(round(float(s) * 100))}"
        cells += [F.coalesce(F.max(F.when(here, F.col(c))), F.lit(0.0)).alias(f"{name}{end}") for c, end in ((mean, ""), (std, "_std"))]
    return summary.groupBy("policy").agg(*cells)


def gap_to_baseline(summary: DataFrame, baseline: str) -> DataFrame:
    """Baseline mean - policy mean per (gamma, size) where both exist."""
    keys = ["gamma", "cache_size_pct"]
    base = summary.filter(F.col("policy") == baseline).groupBy(*keys).agg(F.avg("hit_rate_mean").alias("_b"))
    pol = summary.filter(F.col("policy") != baseline).groupBy(*keys, "policy").agg(F.avg("hit_rate_mean").alias("_p"))
    return base.join(pol, keys).select(*keys, "policy", F.round(F.col("_b") - F.col("_p"), 6).alias("gap"))


def sweep_series(runs: DataFrame) -> DataFrame:
    """Per (policy, gamma), ordered by gamma: hit rate mean/std, coverage, and whether
    the mean does not fall compared to the previous gamma."""
    s = runs.groupBy("policy", "gamma").agg(
        F.round(F.avg("final_hit_rate"), 6).alias("hit_rate_mean"),
        F.round(F.stddev_pop("final_hit_rate"), 6).alias("hit_rate_std"),
        F.round(F.avg("semantic_coverage_avg_dist"), 6).alias("coverage_mean"),
        F.round(F.avg("diversity"), 6).alias("diversity_mean"))
    # one row per (policy, gamma value): a few dozen rows per policy
    w = Window.partitionBy("policy").orderBy("gamma")
    return s.withColumn("non_decreasing", F.coalesce(F.col("hit_rate_mean") >= F.lag("hit_rate_mean").over(w), F.lit(True)))


# ------------------------------------------------------------------------------ I8, I12, I13

def stream_positions(flagged: DataFrame, stream_col: str) -> DataFrame:
    """Position 0.. of each access inside its stream (skew-safe numbering) and cumulative hits."""
    pos = dense_ids(flagged, ["seq"], out_col="pos", partition_by=[stream_col])
    return running_sum(pos.withColumn("_h", F.col("hit").cast("long")), ["pos"], "_h", "cum_hits",
                       inclusive=True, partition_by=[stream_col]).drop("_h")


def cumulative_hit_rate(flagged: DataFrame, stream_col: str = "event_type", log_interval: int = 500) -> DataFrame:
    """Running hits / position, every ``log_interval`` rows and at the end of each stream."""
    p = stream_positions(flagged, stream_col)
    last = p.groupBy(stream_col).agg(F.max("pos").alias("_last"))
    return (p.join(last, stream_col)
            .filter(((F.col("pos") + 1) % log_interval == 0) | (F.col("pos") == F.col("_last")))
            .select(stream_col, (F.col("pos") + 1).alias("query_idx"),
                    F.round(F.col("cum_hits") / (F.col("pos") + 1), 6).alias("cumulative_hit_rate")))


def rolling_hit_rate(flagged: DataFrame, stream_col: str = "event_type", window: int = 1000,
                     log_interval: int = 500) -> DataFrame:
    """Mean of the last ``window`` (or fewer) outcomes, at the logged positions.

    The rolling sum is cum(pos) - cum(pos - window): an equi join on position, balanced by
    the hash of (stream, position)."""
    p = stream_positions(flagged, stream_col)
    last = p.groupBy(stream_col).agg(F.max("pos").alias("_last"))
    logged = p.join(last, stream_col).filter(((F.col("pos") + 1) % log_interval == 0) | (F.col("pos") == F.col("_last")))
    back = p.select(stream_col, (F.col("pos") + window).alias("pos"), F.col("cum_hits").alias("_cum_back"))
    return (logged.join(back, [stream_col, "pos"], "left")
            .select(stream_col, (F.col("pos") + 1).alias("query_idx"),
                    F.round((F.col("cum_hits") - F.coalesce("_cum_back", F.lit(0)))
                            / F.least(F.col("pos") + 1, F.lit(window)), 6).alias("rolling_hit_rate")))


def checkpoint_bands(flagged: DataFrame, every: int = 100) -> DataFrame:
    """I8: per run cell (policy, size) the mean and std(pop) across seeds of the cumulative hit
    rate, the hit rate since the checkpoint before, and the evictions (misses) so far."""
    runs = flagged.withColumn("policy", F.col("event_type")) \
        .withColumn("cache_size_pct", (F.col("key") % 3 + 1) / 10.0) \
        .withColumn("seed", F.col("event_id") % 3) \
        .withColumn("_run", F.concat_ws("|", "policy", "cache_size_pct", "seed"))
    p = stream_positions(runs, "_run")
    pts = p.filter((F.col("pos") + 1) % every == 0).select("_run", "policy", "cache_size_pct", (F.col("pos") + 1).alias("query_idx"), "cum_hits")
    before = pts.select("_run", (F.col("query_idx") + every).alias("query_idx"), F.col("cum_hits").alias("_before"))
    pts = (pts.join(before, ["_run", "query_idx"], "left")
           .withColumn("rate", F.col("cum_hits") / F.col("query_idx"))
           .withColumn("rolling", (F.col("cum_hits") - F.coalesce("_before", F.lit(0))) / every)
           .withColumn("evictions", F.col("query_idx") - F.col("cum_hits")))
    bands = [f(c).alias(f"{c}_{name}") for c in ("rate", "rolling", "evictions")
             for name, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_pop(c), 6)))]
    return pts.groupBy("policy", "cache_size_pct", "query_idx").agg(*bands, F.count(F.lit(1)).alias("n_seeds"))

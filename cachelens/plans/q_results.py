"""Registered result-analytics queries (I1-I4, I7-I13, F19, F20) on part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cachelens.operators import results as X
from cachelens.plans.catalog import ORACLES, T, register
from cachelens.session import materialize, scratch_path
from cachelens.streaming.running_rates import run_running_rates

LOG = """log AS (SELECT user_id AS key, event_id, event_type, value, ts,
                   row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)"""
FLAG = f"""{LOG},
f AS (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY key ORDER BY seq) <= 100, false) AS hit FROM log)"""
RUNS = f"""{FLAG},
runs AS (
  SELECT event_type AS policy, (key % 3 + 1)::DOUBLE / 10.0::DOUBLE AS cache_size_pct, event_id % 3 AS seed,
         (event_id % 5)::DOUBLE / 4.0::DOUBLE AS gamma, avg(hit::INTEGER::DOUBLE) AS final_hit_rate,
         avg(value) AS semantic_coverage_avg_dist, count(*) AS n_queries, 'temporal' AS workload,
         (epoch_us(max(ts::TIMESTAMP)) - epoch_us(min(ts::TIMESTAMP))) / 1e6 AS stream_time_s,
         count(*) FILTER (WHERE NOT hit) AS n_evictions, count(DISTINCT key)::DOUBLE / count(*) AS diversity
  FROM f GROUP BY 1, 2, 3, 4)"""
SUMMARY_COLS = """round(avg(final_hit_rate), 6) AS hit_rate_mean, round(stddev_pop(final_hit_rate), 6) AS hit_rate_std,
       round(avg(semantic_coverage_avg_dist), 6) AS coverage_mean,
       round(stddev_pop(semantic_coverage_avg_dist), 6) AS coverage_std, round(avg(stream_time_s), 3) AS stream_time_mean_s,
       round(avg(n_evictions), 1) AS evictions_mean, round(avg(diversity), 6) AS diversity_mean, count(*) AS n_runs"""
SIZES = [0.1, 0.2, 0.3]
POLICIES = ["click", "error", "oracle", "purchase", "signup", "view"]


def _part(spark, sf):
    return T(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")


def _flags(spark, sf):
    return X.hit_flags(T(spark, sf, "events"))


def _runs(spark, sf):
    return X.runs_from_events(T(spark, sf, "events"))


@register("best_per_group", """
SELECT p_partkey, p_brand, p_size, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1
""")
def q_best_per_group(spark, sf):
    return X.best_per_group(_part(spark, sf), "p_brand", "p_retailprice", "p_partkey")


@register("pareto_min_max", """
WITH p AS (SELECT p_partkey, p_size, p_retailprice,
                  max(p_retailprice) OVER (ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
           FROM part)
SELECT p_partkey, p_size, p_retailprice FROM p WHERE p_retailprice > greatest(coalesce(pm, -1.0), -1.0)
""")
def q_pareto_min_max(spark, sf):
    return X.pareto_min_max(_part(spark, sf), "p_size", "p_retailprice", "p_partkey") \
        .select("p_partkey", "p_size", "p_retailprice")


@register("pareto_nondominated", """
SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a
WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice
                  AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))
""")
def q_pareto_nondominated(spark, sf):
    return X.pareto_nondominated(_part(spark, sf), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@register("pareto_nonstrict", """
WITH p AS (SELECT p_partkey, p_size, p_retailprice,
                  max(p_retailprice) OVER (ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
           FROM part)
SELECT p_partkey, p_size, p_retailprice FROM p WHERE pm IS NULL OR p_retailprice >= pm
""")
def q_pareto_nonstrict(spark, sf):
    return X.pareto_nonstrict(_part(spark, sf), "p_size", "p_retailprice", "p_partkey") \
        .select("p_partkey", "p_size", "p_retailprice")


@register("hit_flags", f"WITH {FLAG} SELECT key, seq, hit FROM f")
def q_hit_flags(spark, sf):
    return _flags(spark, sf).select("key", "seq", "hit")


@register("cumulative_hit_rate", f"""
WITH {FLAG},
p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1 AS pos,
             sum(hit::INTEGER) OVER (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum,
             count(*) OVER (PARTITION BY event_type) AS n FROM f)
SELECT event_type, pos + 1 AS query_idx, round(cum / (pos + 1), 6) AS cumulative_hit_rate
FROM p WHERE (pos + 1) % 500 = 0 OR pos = n - 1
""")
def q_cumulative_hit_rate(spark, sf):
    return X.cumulative_hit_rate(_flags(spark, sf))


#: Files that the accesses arrive in, by position.
STREAM_FILES = 4


@register("stream_running_rate", ORACLES["cumulative_hit_rate"])
def q_stream_running_rate(spark, sf):
    """S2 with running totals: the accesses arrive in files, a micro-batch each, and pass the checkpoints of I12."""
    flags = materialize(_flags(spark, sf).select("seq", "event_type", "hit"), "flags")
    n = flags.count()
    folder = scratch_path(spark, "accesses")
    part = F.floor(F.col("seq") * STREAM_FILES / max(n, 1)).cast("int")
    for i in range(STREAM_FILES):  # written one after the other: a file stream goes by time
        flags.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    live = spark.readStream.schema(flags.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return run_running_rates(live)


@register("rolling_hit_rate", f"""
WITH {FLAG},
p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1 AS pos,
             sum(hit::INTEGER) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS roll,
             count(*) OVER (PARTITION BY event_type) AS n FROM f)
SELECT event_type, pos + 1 AS query_idx, round(roll / least(pos + 1, 1000), 6) AS rolling_hit_rate
FROM p WHERE (pos + 1) % 500 = 0 OR pos = n - 1
""")
def q_rolling_hit_rate(spark, sf):
    return X.rolling_hit_rate(_flags(spark, sf))


@register("checkpoint_bands", f"""
WITH {FLAG},
r AS (SELECT event_type AS policy, (key % 3 + 1)::DOUBLE / 10.0::DOUBLE AS cache_size_pct, event_id % 3 AS seed,
             row_number() OVER (PARTITION BY event_type, key % 3, event_id % 3 ORDER BY seq) AS idx,
             sum(hit::INTEGER) OVER (PARTITION BY event_type, key % 3, event_id % 3 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum,
             sum(hit::INTEGER) OVER (PARTITION BY event_type, key % 3, event_id % 3 ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS roll
      FROM f)
SELECT policy, cache_size_pct, idx AS query_idx, round(avg(cum / idx), 6) AS rate_mean, round(stddev_pop(cum / idx), 6) AS rate_std,
       round(avg(roll / 100), 6) AS rolling_mean, round(stddev_pop(roll / 100), 6) AS rolling_std,
       round(avg(idx - cum), 6) AS evictions_mean, round(stddev_pop(idx - cum), 6) AS evictions_std, count(*) AS n_seeds
FROM r WHERE idx % 100 = 0 GROUP BY 1, 2, 3
""")
def q_checkpoint_bands(spark, sf):
    return X.checkpoint_bands(_flags(spark, sf))


@register("scan_run_records", f"""
WITH {RUNS}
SELECT policy, cache_size_pct, seed, workload, gamma, round(final_hit_rate, 6) AS final_hit_rate,
       round(semantic_coverage_avg_dist, 6) AS semantic_coverage_avg_dist, round(diversity, 6) AS diversity,
       round(stream_time_s, 3) AS stream_time_s, n_evictions FROM runs
""")
def q_scan_run_records(spark, sf):
    """The runs written as record documents and read back."""
    from cachelens.session import scratch_path
    from cachelens.sources.run_records import scan_run_records, write_run_records

    folder = write_run_records(_runs(spark, sf), scratch_path(spark, "run-records"))
    back = scan_run_records(spark, folder, lines=True).drop("checkpoints")
    for c, digits in (("final_hit_rate", 6), ("semantic_coverage_avg_dist", 6), ("diversity", 6), ("stream_time_s", 3)):
        back = back.withColumn(c, F.round(c, digits))
    return back


@register("runs_summary", f"""
WITH {RUNS}
SELECT policy, cache_size_pct, workload, {SUMMARY_COLS} FROM runs GROUP BY policy, cache_size_pct, workload
""")
def q_runs_summary(spark, sf):
    return X.runs_summary(_runs(spark, sf))


@register("runs_summary_gamma", f"""
WITH {RUNS}
SELECT gamma, policy, cache_size_pct, workload, {SUMMARY_COLS} FROM runs GROUP BY gamma, policy, cache_size_pct, workload
""")
def q_runs_summary_gamma(spark, sf):
    return X.runs_summary(_runs(spark, sf), by_gamma=True)


@register("dominance_check", f"""
WITH {RUNS},
s AS (SELECT policy, cache_size_pct, workload, {SUMMARY_COLS} FROM runs GROUP BY policy, cache_size_pct, workload)
SELECT b.cache_size_pct, b.workload, b.hit_rate_mean AS baseline_mean, o.policy, o.hit_rate_mean AS policy_mean,
       round(o.hit_rate_mean - b.hit_rate_mean, 6) AS gap
FROM s b JOIN s o ON o.cache_size_pct = b.cache_size_pct AND o.workload = b.workload AND o.policy <> 'view'
WHERE b.policy = 'view' AND b.hit_rate_mean < o.hit_rate_mean - 0.001
""")
def q_dominance_check(spark, sf):
    return X.dominance_check(X.runs_summary(_runs(spark, sf)), "view")


@register("matrix_completeness", f"""
WITH {RUNS},
cells AS (SELECT p AS policy, s AS cache_size_pct FROM (VALUES {', '.join(f"('{p}')" for p in POLICIES)}) a(p),
          (VALUES {', '.join(f'({s!r}::DOUBLE)' for s in SIZES)}) b(s)),
c AS (SELECT policy, cache_size_pct, count(*) AS n FROM runs GROUP BY 1, 2)
SELECT cells.policy, cells.cache_size_pct, coalesce(c.n, 0)::BIGINT AS n_runs,
       CASE WHEN coalesce(c.n, 0) = 0 THEN 'missing' WHEN c.n < 3 THEN 'incomplete' ELSE 'ok' END AS status
FROM cells LEFT JOIN c ON c.policy = cells.policy AND c.cache_size_pct = cells.cache_size_pct
""")
def q_matrix_completeness(spark, sf):
    return X.matrix_completeness(_runs(spark, sf), POLICIES, SIZES, seeds_required=3)


@register("policy_matrix", f"""
WITH {RUNS},
s AS (SELECT policy, cache_size_pct, round(avg(final_hit_rate), 6) AS m, round(stddev_pop(final_hit_rate), 6) AS sd FROM runs GROUP BY 1, 2)
SELECT policy, {', '.join(f"coalesce(max({v}) FILTER (WHERE cache_size_pct = {s!r}::DOUBLE), 0.0) AS size_{int(round(s * 100))}{e}" for s in SIZES for v, e in (('m', ''), ('sd', '_std')))}
FROM s GROUP BY policy
""")
def q_policy_matrix(spark, sf):
    return X.policy_matrix(X.runs_summary(_runs(spark, sf)), SIZES)


@register("gap_to_baseline", f"""
WITH {RUNS},
s AS (SELECT gamma, policy, cache_size_pct, round(avg(final_hit_rate), 6) AS m FROM runs GROUP BY 1, 2, 3)
SELECT b.gamma, b.cache_size_pct, o.policy, round(b.m - o.m, 6) AS gap
FROM s b JOIN s o ON o.gamma = b.gamma AND o.cache_size_pct = b.cache_size_pct AND o.policy <> 'view'
WHERE b.policy = 'view'
""")
def q_gap_to_baseline(spark, sf):
    return X.gap_to_baseline(X.runs_summary(_runs(spark, sf), by_gamma=True), "view")


@register("sweep_series", f"""
WITH {RUNS},
s AS (SELECT policy, gamma, round(avg(final_hit_rate), 6) AS hit_rate_mean, round(stddev_pop(final_hit_rate), 6) AS hit_rate_std,
             round(avg(semantic_coverage_avg_dist), 6) AS coverage_mean, round(avg(diversity), 6) AS diversity_mean FROM runs GROUP BY 1, 2)
SELECT *, coalesce(hit_rate_mean >= lag(hit_rate_mean) OVER (PARTITION BY policy ORDER BY gamma), true) AS non_decreasing FROM s
""")
def q_sweep_series(spark, sf):
    return X.sweep_series(_runs(spark, sf))

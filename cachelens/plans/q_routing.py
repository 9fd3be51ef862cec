"""Registered routing queries (flagship: holdout -> exact kNN -> threshold sweep)."""

from __future__ import annotations

from cachelens.operators import routing
from cachelens.plans import sqlfrag as S
from cachelens.plans.catalog import T, register
from cachelens.plans.routing_eval import flagship


@register("threshold_sweep", f"""
WITH {S.holdout_nn()},
{S.sweep_select('nn', routing.DEFAULT_THRESHOLDS)}
""")
def q_threshold_sweep(spark, sf):
    return flagship(T(spark, sf, "embeddings"))


# --------------------------------------------------------------------------------------------
# per-query routing on the holdout nearest neighbours

from pyspark.sql import functions as F  # noqa: E402

from cachelens.functions.cost import CostModel  # noqa: E402
from cachelens.functions.vector import cosine_quality  # noqa: E402
from cachelens.operators.vectors import collect_centroids  # noqa: E402
from cachelens.plans import evaluation as EV  # noqa: E402
from cachelens.plans.routing_eval import holdout_nn  # noqa: E402

NN = S.holdout_nn()


def _nn(spark, sf):
    return holdout_nn(T(spark, sf, "embeddings"))


@register("cosine_quality", f"WITH {NN} SELECT query_id, round({S.cosine_quality('dist')}, 6) AS quality FROM nn")
def q_cosine_quality(spark, sf):
    return _nn(spark, sf).select("query_id", F.round(cosine_quality(F.col("dist")), 6).alias("quality"))


@register("route", f"""
WITH {NN}
SELECT query_id, nn_id, round(dist, 6) AS dist, gt_id, round(gt_dist, 6) AS gt_dist,
       CASE WHEN dist <= 1.2 THEN 'cache' ELSE 'llm' END AS action,
       round(greatest(0.0, 1.0 - dist / 2.0), 6) AS confidence,
       CASE WHEN dist <= 1.2 THEN nn_id ELSE -1 END AS cache_index, 1.2::DOUBLE AS threshold
FROM nn""")
def q_route(spark, sf):
    r = routing.route(_nn(spark, sf), 1.2)
    return r.withColumn("confidence", F.round("confidence", 6)).withColumn("dist", F.round("dist", 6)) \
        .withColumn("gt_dist", F.round("gt_dist", 6))


@register("router_stats", f"""
WITH {NN}
SELECT count(*) AS total_queries, count(*) FILTER (WHERE dist <= 1.2) AS cache_hits,
       count(*) FILTER (WHERE NOT dist <= 1.2 OR dist IS NULL) AS llm_calls,
       round(count(*) FILTER (WHERE dist <= 1.2) / count(*), 4) AS hit_rate,
       round(avg(dist), 4) AS avg_distance, round(quantile_cont(dist, 0.5), 4) AS median_distance,
       round(min(dist), 4) AS min_distance, round(max(dist), 4) AS max_distance
FROM nn""")
def q_router_stats(spark, sf):
    return routing.router_stats(routing.route(_nn(spark, sf), 1.2))


@register("routing_cost", f"""
WITH {NN}
SELECT count(*) AS n_queries,
       round(sum(CASE WHEN dist <= 1.2 THEN 1.0::DOUBLE ELSE 511.0::DOUBLE END), 6) AS total_cost,
       round(avg(CASE WHEN dist <= 1.2 THEN 1.0::DOUBLE ELSE 511.0::DOUBLE END), 6) AS avg_cost,
       round(count(*) * 510.0::DOUBLE, 6) AS direct_llm_total_cost
FROM nn""")
def q_routing_cost(spark, sf):
    return routing.routing_cost(routing.route(_nn(spark, sf), 1.2), CostModel())


_LAT, _LATP, _COST, _MONP = S.savings("hit_rate", cache_ms=1.0)


@register("cost_savings", f"""
WITH {NN},
h AS (SELECT hs.label, avg(CASE WHEN nn.dist <= 1.2 THEN 1.0 ELSE 0.0 END) AS hit_rate
      FROM nn JOIN hs ON hs.vec_id = nn.query_id GROUP BY hs.label)
SELECT label, hit_rate, {_LAT} AS avg_latency_ms, {_LATP} AS latency_saving_pct, {_COST} AS avg_cost_usd,
       {_MONP} AS monetary_saving_pct FROM h""")
def q_cost_savings(spark, sf):
    emb = T(spark, sf, "embeddings")
    nn = _nn(spark, sf).join(emb.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    h = nn.groupBy("label").agg(F.avg(F.when(F.col("dist") <= 1.2, 1.0).otherwise(0.0)).alias("hit_rate"))
    return routing.cost_savings(h, "hit_rate", CostModel())


@register("hit_quality", f"""
WITH {NN},
{S.sweep_select('nn', [1.2])}""".replace(
    "SELECT round(threshold, 4) AS threshold,", "SELECT round(threshold, 4) AS threshold, n_hits::BIGINT AS _nh,", 1))
def q_hit_quality(spark, sf):
    sw = routing.threshold_sweep(_nn(spark, sf), [1.2])
    return sw.withColumn("_nh", F.col("n_hits"))


def _calib_sql(nn: str, min_quality: float) -> str:
    ts = routing.CALIBRATION_THRESHOLDS
    h = "(n_hits / n)"
    lat, lat_pct, cost, mon_pct = S.savings(h, 0.5)
    return f"""
cs AS (
  SELECT t.j, t.threshold, (SELECT count(*) FROM {nn})::DOUBLE AS n, count(x.query_id) AS n_hits,
         sum({S.cosine_quality('x.dist')}) AS sq
  FROM {S.values([(j, float(t)) for j, t in enumerate(ts)], 'j, threshold', 't')}
  LEFT JOIN {nn} x ON x.dist <= t.threshold GROUP BY t.j, t.threshold),
sc AS (
  SELECT j, threshold, {h} AS hit_rate, CASE WHEN n_hits > 0 THEN sq / n_hits ELSE 1.0 END AS quality,
         n_hits::BIGINT AS n_hits, (n - n_hits)::BIGINT AS n_misses, {lat_pct} AS latency_saving_pct,
         {mon_pct} AS monetary_saving_pct FROM cs),
ob AS (
  SELECT *, quality >= {float(min_quality)!r}::DOUBLE AS feasible,
         CASE WHEN quality >= {float(min_quality)!r}::DOUBLE
              THEN latency_saving_pct + monetary_saving_pct - 2.0 * (1.0 - quality) * 100.0 END AS objective FROM sc),
ch AS (SELECT *, row_number() OVER (ORDER BY feasible DESC, objective DESC NULLS LAST, j) = 1 AS chosen FROM ob)"""


@register("calibrate_threshold", f"""
WITH {NN}, {_calib_sql('nn', 0.35)}
SELECT round(threshold, 4) AS threshold, round(hit_rate, 4) AS hit_rate, round(quality, 4) AS quality, n_hits, n_misses,
       latency_saving_pct, monetary_saving_pct, round(objective, 4) AS objective, chosen FROM ch""")
def q_calibrate_threshold(spark, sf):
    return routing.calibrate_threshold(_nn(spark, sf), min_quality=0.35).drop("_t_exact")


ADAPTIVE_SQL = f"""
r AS (SELECT *, row_number() OVER (ORDER BY {S.md5_key(43, 'calibration', 'query_id')}, query_id)
                <= (SELECT greatest(10, floor(count(*) * 0.2::DOUBLE)) FROM nn) AS is_cal FROM nn),
cal AS (SELECT * FROM r WHERE is_cal), test AS (SELECT * FROM r WHERE NOT is_cal),
{_calib_sql('cal', 0.35)},
bt AS (SELECT threshold AS t FROM ch WHERE chosen),
a AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE dist <= t) AS n_hits,
             sum(CASE WHEN dist <= t THEN {S.cosine_quality('dist')} END) AS sq,
             count(*) FILTER (WHERE dist <= t AND nn_id = gt_id) AS ss,
             count(*) FILTER (WHERE dist <= t AND dist <= gt_dist * 2.0 + 0.01) AS sd FROM test, bt),
h AS (SELECT *, CASE WHEN n > 0 THEN n_hits / n ELSE 0.0 END AS hr FROM a),
ad AS (
SELECT round((SELECT t FROM bt), 4) AS best_threshold, (SELECT count(*) FROM cal) AS calibration_size,
       n::BIGINT AS test_size, round(hr, 4) AS test_hit_rate,
       round(CASE WHEN n_hits > 0 THEN sq / n_hits ELSE 1.0 END, 4) AS retrieval_similarity,
       round(CASE WHEN n_hits > 0 THEN ss / n_hits ELSE 1.0 END, 4) AS recall_at_1,
       round(CASE WHEN n_hits > 0 THEN sd / n_hits ELSE 1.0 END, 4) AS distance_quality,
       {S.savings('hr', 0.5)[1]} AS latency_saving_pct, {S.savings('hr', 0.5)[3]} AS monetary_saving_pct
FROM h)"""


@register("adaptive_routing", f"WITH {NN},{ADAPTIVE_SQL} SELECT * FROM ad")
def q_adaptive_routing(spark, sf):
    return routing.adaptive_routing(_nn(spark, sf), min_quality=0.35)


@register("latency_sensitivity", f"""
WITH {NN},
h AS (SELECT avg(CASE WHEN dist <= 1.2 THEN 1.0 ELSE 0.0 END) AS hr FROM nn)
SELECT round(hr, 4) AS hit_rate, l AS llm_latency_ms,
       round(hr * 0.5 + (1.0 - hr) * (0.5 + l), 6) AS effective_latency_ms,
       round((l - (hr * 0.5 + (1.0 - hr) * (0.5 + l))) / l * 100.0, 2) AS latency_saving_pct
FROM h, {S.values([float(x) for x in routing.SENSITIVITY_LATENCIES_MS], 'l', 'ls')}""")
def q_latency_sensitivity(spark, sf):
    nn = _nn(spark, sf)
    h = nn.agg(F.avg(F.when(F.col("dist") <= 1.2, 1.0).otherwise(0.0)).alias("hit_rate"))
    return routing.latency_sensitivity(h)


STRATEGY_SQL = " UNION ALL ".join(
    f"SELECT *, '{st}' AS strategy, 'flat' AS backend FROM (WITH {S.fill_nn(st, table='embeddings')}, "
    f"{S.sweep_select('nn', routing.DEFAULT_THRESHOLDS)})"
    for st in ("random", "chronological"))


@register("strategy_evaluation", STRATEGY_SQL)
def q_strategy_evaluation(spark, sf):
    return EV.strategy_evaluation(T(spark, sf, "embeddings"))


@register("best_fixed_threshold", f"""
SELECT * FROM ({STRATEGY_SQL}) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY latency_saving_pct DESC, threshold) = 1""")
def q_best_fixed_threshold(spark, sf):
    return EV.best_fixed_threshold(EV.strategy_evaluation(T(spark, sf, "embeddings")))


IVF_FILL_NN = f"""
{S.fill_nn(table='embeddings')},
fc AS (SELECT * FROM fs WHERE is_cache), fe AS (SELECT * FROM fs WHERE NOT is_cache),{S.label_cells('fs')},
{S.ivf_pairs('fe', 'fc', 4)},
best AS (SELECT query_id, nn_id, dist FROM ivf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, nn_id) = 1),
ann AS (SELECT nn.query_id, best.nn_id, best.dist, nn.gt_id, nn.gt_dist FROM nn LEFT JOIN best ON best.query_id = nn.query_id)"""


@register("backend_comparison", f"""
SELECT *, 'random' AS strategy, 'flat' AS backend, NULL::VARCHAR AS error
FROM (WITH {S.fill_nn(table='embeddings')}, {S.sweep_select('nn', routing.DEFAULT_THRESHOLDS)})
UNION ALL SELECT *, 'random', 'ivf', NULL FROM (WITH {IVF_FILL_NN}, {S.sweep_select('ann', routing.DEFAULT_THRESHOLDS)})""")
def q_backend_comparison(spark, sf):
    emb = T(spark, sf, "embeddings")
    centers = collect_centroids(emb, "label")[1]
    return EV.backend_comparison(emb, (("flat", {}), ("ivf", {"nlist": len(centers), "nprobe": 4, "centers": centers})))


def _seed_rows_sql() -> str:
    parts = []
    for seed in (42, 123, 456):
        for st in ("random", "chronological"):
            parts.append(f"SELECT '{st}' AS strategy, {seed} AS seed, * FROM (WITH {S.fill_nn(st, seed=seed, table='embeddings')}, "
                         f"{S.sweep_select('nn', [1.2])})")
    return " UNION ALL ".join(parts)


@register("multi_seed_summary", f"""
WITH r AS ({_seed_rows_sql()}),
l AS (UNPIVOT (SELECT strategy, seed, {', '.join(f'{m}::DOUBLE AS {m}' for m in EV.METRICS)} FROM r)
      ON {', '.join(EV.METRICS)} INTO NAME metric VALUE value)
SELECT strategy, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
       round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS n_seeds
FROM l WHERE value IS NOT NULL GROUP BY strategy, metric""")
def q_multi_seed_summary(spark, sf):
    return EV.multi_seed_summary(T(spark, sf, "embeddings"))


# The benchmark that SQL can state: the uniform workload with given centres (the label means), exact, five probe
# counts and one code length, at two scales. ``knn_benchmark_grid`` is the whole grid.
BENCH_PROBES, BENCH_BITS = (1, 2, 4, 6, 8), 64
BENCH_SCALES = (("half", 0.5), ("full", 1.0))


def bench_runs(spark, sf):
    emb = T(spark, sf, "embeddings")
    centers = collect_centroids(emb, "label")[1]
    return EV.knn_benchmark_scales(emb, BENCH_SCALES, ivf_grid=[(len(centers), p) for p in BENCH_PROBES], lsh_grid=[BENCH_BITS],
                                   workloads=("uniform",), centers=centers)


def _scale_sql(label: str, frac: float) -> str:
    rows = "embeddings" if frac >= 1 else (
        f"(SELECT * FROM embeddings ORDER BY {S.md5_key(42, f'scale:{label}', 'vec_id')}, vec_id "
        f"LIMIT (SELECT floor(count(*) * {frac!r}::DOUBLE)::BIGINT FROM embeddings))")
    nlist = "(SELECT count(DISTINCT label) FROM embeddings)"
    probes = ",".join(S.ivf_pairs("hq", "hd", p, name=f"ivf{p}") for p in BENCH_PROBES)
    kinds = [("flat", "MAP {}", S.topk("pairs", 10))]
    kinds += [("ivf", f"MAP {{'nlist': {nlist}::DOUBLE, 'nprobe': {float(p)!r}::DOUBLE}}", S.topk(f"ivf{p}", 10)) for p in BENCH_PROBES]
    kinds += [("lsh", f"MAP {{'nbits': {float(BENCH_BITS)!r}::DOUBLE}}", S.topk("hpairs", 10, "hamming"))]
    found = " UNION ALL ".join(f"SELECT {i} AS config, query_id, neighbor_id, rank FROM ({sql})" for i, (_, _, sql) in enumerate(kinds))
    names = " UNION ALL ".join(f"SELECT {i} AS config, '{kind}' AS index_type, {p}::MAP(VARCHAR, DOUBLE) AS params" for i, (kind, p, _) in enumerate(kinds))
    recall = ", ".join(
        f"round(avg((SELECT count(*) FROM truth t JOIN found f ON f.query_id = t.query_id AND f.neighbor_id = t.neighbor_id "
        f"WHERE t.query_id = qs.query_id AND f.config = names.config AND t.rank <= {k} AND f.rank <= {k})::DOUBLE "
        f"/ (SELECT count(*) FROM truth t WHERE t.query_id = qs.query_id AND t.rank <= {k})), 6) AS recall_at_{k}" for k in (1, 5, 10))
    return f"""(
WITH own AS (SELECT * FROM {rows}),
hs AS (SELECT vec_id, embedding, label, row_number() OVER (ORDER BY {S.md5_key(42, 'holdout', 'vec_id')}, vec_id)
              <= (SELECT least(1000, count(*) // 5) FROM own) AS is_q FROM own),
hq AS (SELECT * FROM hs WHERE is_q), hd AS (SELECT * FROM hs WHERE NOT is_q),{S.label_cells('hs')},{probes},
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {S.sq_l2('q.embedding', 'd.embedding')} AS dist FROM hq q, hd d),
{S.lsh_bits('hs', BENCH_BITS)},
hpairs AS (SELECT qb.vec_id AS query_id, db.vec_id AS nn_id, sum(CASE WHEN qb.bit <> db.bit THEN 1 ELSE 0 END)::DOUBLE AS hamming
           FROM bits qb JOIN hq q ON q.vec_id = qb.vec_id JOIN bits db ON db.p = qb.p JOIN hd d ON d.vec_id = db.vec_id GROUP BY 1, 2),
truth AS ({S.topk('pairs', 10)}), qs AS (SELECT DISTINCT query_id FROM truth), found AS ({found}), names AS ({names})
SELECT index_type, params, (SELECT count(*) FROM hd) AS dataset_size, '{label}' AS dataset_label, 'uniform' AS workload, {recall},
       NULL::VARCHAR AS error
FROM names, qs GROUP BY names.config, index_type, params)"""


BENCH_SQL = "SELECT * EXCLUDE (params), params['nlist'] AS nlist, params['nprobe'] AS nprobe, params['nbits'] AS nbits FROM (" \
    + " UNION ALL ".join(f"SELECT * FROM {_scale_sql(*s)}" for s in BENCH_SCALES) + ")"


def flat_params(runs):
    return runs.select("*", *[F.col("params")[p].alias(p) for p in ("nlist", "nprobe", "nbits")]).drop("params")


@register("knn_benchmark", BENCH_SQL)
def q_knn_benchmark(spark, sf):
    return flat_params(bench_runs(spark, sf))


@register("knn_benchmark_grid")
def q_knn_benchmark_grid(spark, sf):
    """F16 over the library's whole grid (14 IVF and 3 LSH settings, trained centres) under all three workloads; settings
    with more cells than rows are error rows."""
    return flat_params(EV.knn_benchmark(T(spark, sf, "embeddings"), "full"))


@register("best_config", f"""
SELECT * FROM ({BENCH_SQL}) WHERE index_type = 'ivf'
ORDER BY recall_at_10 DESC, dataset_label, workload, nlist, nprobe LIMIT 1""")
def q_best_config(spark, sf):
    return flat_params(EV.best_config(bench_runs(spark, sf), "ivf"))


@register("parameter_sensitivity", f"""
SELECT dataset_label, nlist, unnest(list(nprobe ORDER BY nprobe)) AS nprobe, unnest(list(recall_at_10 ORDER BY nprobe)) AS recall_at_10
FROM ({BENCH_SQL}) WHERE index_type = 'ivf'
GROUP BY dataset_label, nlist""")
def q_parameter_sensitivity(spark, sf):
    series = EV.parameter_sensitivity(bench_runs(spark, sf))
    return series.select("dataset_label", "nlist", F.inline("series"))


@register("scaling_series", f"""
SELECT index_type, dataset_label, dataset_size, recall_at_10 FROM ({BENCH_SQL})
QUALIFY row_number() OVER (PARTITION BY index_type, dataset_label ORDER BY recall_at_10 DESC) = 1""")
def q_scaling_series(spark, sf):
    return EV.scaling_series(bench_runs(spark, sf)).drop("params")


@register("row_expectations", f"""
SELECT dataset_label, count(*) AS n_rows, count(*) FILTER (WHERE workload IS NULL) AS n_missing_workload,
       NOT contains(dataset_label, 'full') OR count(*) >= 500000 AS scale_ok,
       count(*) FILTER (WHERE workload IS NULL) = 0 AND (NOT contains(dataset_label, 'full') OR count(*) >= 500000) AS ok
FROM ({BENCH_SQL}) GROUP BY dataset_label""")
def q_row_expectations(spark, sf):
    """C11 on the benchmark result table: every row has a workload, `full` labels reach scale."""
    from cachelens.operators.sampling import row_expectations

    return row_expectations(bench_runs(spark, sf))


_BUNDLE = " UNION ALL ".join(f"""
SELECT '{st}' AS strategy, 'flat' AS backend, b.*, round(avg(dist), 4) AS dist_mean, round(stddev_pop(dist), 4) AS dist_std,
       round(quantile_cont(dist, 0.5), 4) AS dist_median, round(min(dist), 4) AS dist_min, round(max(dist), 4) AS dist_max,
       round(quantile_cont(dist, 0.05), 4) AS dist_p5, round(quantile_cont(dist, 0.95), 4) AS dist_p95
FROM (WITH {S.fill_nn(st, table='embeddings')} SELECT dist FROM nn) d, (
  WITH {S.fill_nn(st, table='embeddings')},{ADAPTIVE_SQL}
  SELECT (SELECT count(*) FROM fs WHERE is_cache) AS cache_size, (SELECT count(*) FROM fs WHERE NOT is_cache) AS eval_size, ad.* FROM ad) b
GROUP BY ALL""" for st in ("random", "chronological"))


@register("evaluation_bundle", _BUNDLE)
def q_evaluation_bundle(spark, sf):
    return EV.evaluation_bundle(T(spark, sf, "embeddings"), min_quality=0.35)

import numpy as np
import pytest

from cachelens.functions.cost import CostModel
from cachelens.operators import routing
from cachelens.operators import sampling as S
from cachelens.operators.ordering import dense_ids


def _rows(spark, n):
    return spark.createDataFrame([(i, f"query {i}") for i in range(n)], "doc_id long, text string")


def test_subsets_sizes_full_and_order(spark):
    out = S.fixed_subsets(_rows(spark, 1000), "doc_id", {"s100": 100, "s500": 500}).toPandas()
    sizes = out.groupby("subset").size().to_dict()
    assert sizes == {"s100": 100, "s500": 500, "full": 1000}
    s100 = out[out.subset == "s100"].sort_values("query_id")
    assert list(s100.query_id) == list(range(100)) and s100.doc_id.is_monotonic_increasing


def test_subsets_deterministic_and_oversized_skipped(spark):
    a = S.fixed_subsets(_rows(spark, 500), "doc_id", {"s": 100}, seed=42).filter("subset = 's'").orderBy("query_id")
    b = S.fixed_subsets(_rows(spark, 500), "doc_id", {"s": 100}, seed=42).filter("subset = 's'").orderBy("query_id")
    assert [r.doc_id for r in a.collect()] == [r.doc_id for r in b.collect()]
    small = S.fixed_subsets(_rows(spark, 50), "doc_id", {"s100": 100}).toPandas()
    assert set(small.subset) == {"full"}


def test_holdout_no_leakage_and_size(spark):
    df = spark.range(100).withColumnRenamed("id", "vec_id")
    split = S.holdout_split(df, "vec_id", query_count=1000)
    assert split.filter("split = 'query'").count() == 20
    q, d = split.filter("split = 'query'"), split.filter("split = 'database'")
    assert S.leakage_count(q, d, "vec_id").first().n_leaked == 0


def test_fill_split_strategies(spark):
    df = spark.createDataFrame([(i, [5, 1, 9, 9, 2][i]) for i in range(5)], "vec_id long, frequency long")
    freq = {r.vec_id for r in S.fill_split(df, "vec_id", 0.4, "frequency").filter("part = 'cache'").collect()}
    assert freq == {2, 3}
    chrono = {r.vec_id for r in S.fill_split(df, "vec_id", 0.4, "chronological").filter("part = 'cache'").collect()}
    assert chrono == {0, 1}
    with pytest.raises(ValueError):
        S.fill_split(df, "vec_id", 0.4, "weird")


def _clustered(spark, n=200, k=5):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, k, n)
    df = spark.createDataFrame([(i, int(l)) for i, l in enumerate(labels)], "query_id long, label long")
    return df


@pytest.mark.parametrize("kind", ["uniform", "zipf", "bursty"])
def test_workload_draws_length_and_bounds(spark, kind):
    rows = _clustered(spark)
    fn = {"uniform": lambda: S.sample_uniform(rows, 500),
          "zipf": lambda: S.sample_zipf_clusters(rows, 500),
          "bursty": lambda: S.sample_bursty(rows, 500)}[kind]
    out = fn().toPandas()
    assert len(out) == 500 and sorted(out.draw_id) == list(range(500))
    assert out.query_id.between(0, 199).all()


def test_concentration_monotone_and_deterministic(spark):
    rows = _clustered(spark)
    distinct = []
    for g in (0.0, 0.5, 1.0):
        d = S.sample_concentrated(rows, 500, g).toPandas()
        distinct.append(d.query_id.nunique())
    assert distinct[0] >= distinct[1] >= distinct[2]
    top_share = S.sample_concentrated(rows, 500, 1.0).toPandas().label.value_counts(normalize=True).iloc[0]
    assert top_share > 0.5
    a = S.sample_concentrated(rows, 300, 0.5, seed=7).orderBy("draw_id").toPandas()
    b = S.sample_concentrated(rows, 300, 0.5, seed=7).orderBy("draw_id").toPandas()
    assert a.equals(b)


def test_cost_savings_formula(spark):
    cm = CostModel(llm_latency_ms=500.0, llm_cost_usd=0.01, cache_latency_ms=1.0)
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "hit_rate double")
    got = {r.hit_rate: (r.latency_saving_pct, r.monetary_saving_pct) for r in routing.cost_savings(df, cost=cm).collect()}
    assert got[0.0] == (-0.2, 0.0) and got[0.5] == (49.8, 50.0) and got[1.0] == (99.8, 100.0)


def _nn(spark, d):
    return spark.createDataFrame([(i, float(x) if x is not None else None, i, float(x) if x is not None else None, i)
                                  for i, x in enumerate(d)],
                                 "query_id long, dist double, nn_id long, gt_dist double, gt_id long")


def test_sweep_matches_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.uniform(0.0, 2.0, 300)
    sw = {r.threshold: r for r in routing.threshold_sweep(_nn(spark, list(d)) , [0.3, 1.0, 1.5]).collect()}
    for t in (0.3, 1.0, 1.5):
        hit = d <= t
        assert sw[t].n_hits == hit.sum()
        assert sw[t].hit_rate == round(hit.mean(), 4)
        assert abs(sw[t].retrieval_similarity - round(np.clip(1 - d[hit] / 2, 0, 1).mean(), 4)) < 1e-9


def test_missing_neighbour_is_a_miss(spark):
    routed = routing.route(_nn(spark, [0.1, None]), 0.5).orderBy("query_id").collect()
    assert [r.action for r in routed] == ["cache", "llm"] and routed[1].cache_index == -1


def test_calibration_ties_and_infeasible(spark):
    nn = _nn(spark, [0.5, 0.5, 1.9])
    cal = routing.calibrate_threshold(nn, [0.2, 0.6, 0.7], min_quality=0.5).filter("chosen").first()
    assert cal.threshold == 0.6  # 0.6 and 0.7 tie: the smaller wins
    none = routing.calibrate_threshold(nn, [0.6, 0.7], min_quality=0.99).filter("chosen").first()
    assert none.threshold == 0.6  # nothing feasible -> first threshold


def test_dense_ids_start_offset(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = [r.n for r in dense_ids(df, ["k"], "n", start=5).orderBy("k").collect()]
    assert out == list(range(5, 15))


def test_first_n_flag_is_the_top_n(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    order = S.random_order(42, "x", "doc_id")
    for n in (1, 120, 300, 500):
        got = {r.doc_id for r in df.filter(S.first_n_flag(df, order, n)).collect()}
        assert got == {r.doc_id for r in df.orderBy(*order).limit(n).collect()}


def test_draws_reach_rows_beyond_32_bits(spark):
    """A draw has 52 bits: positions of a table of 2^45 rows are spread over its whole range, odd ones too."""
    from pyspark.sql import functions as F

    from cachelens.functions.draws import uniform_draw

    rows = 2**45
    pos = [r.pos for r in spark.range(4000).select(F.floor(uniform_draw(42, "uniform", "id") * F.lit(rows)).cast("long").alias("pos")).collect()]
    assert len(set(pos)) == 4000 and max(pos) < rows
    assert sum(p > 2**32 for p in pos) > 3990 and 0.45 < np.mean([p % 2 for p in pos]) < 0.55
    assert abs(np.mean(pos) / rows - 0.5) < 0.02

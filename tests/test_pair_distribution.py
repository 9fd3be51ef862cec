"""Pair distributions with whole groups against all pairs."""

import numpy as np
import pytest

from cachelens.operators import vectors as V
from cachelens.operators.vector_join import pair_stats
from tests.conftest import unit, vectors_df


def tight(n_groups=12, per=60, dim=16, noise=1e-4):
    rng = np.random.default_rng(2)
    return unit(np.repeat(rng.normal(size=(n_groups, dim)), per, axis=0) + noise * rng.normal(size=(n_groups * per, dim)))


def products(X):
    X = np.asarray(X, np.float32).astype(np.float64)
    return (X @ X.T)[np.triu_indices(len(X), 1)]


@pytest.mark.parametrize("how", [{}, {"strategy": "grid", "rows_per_block": 200}], ids=str)
@pytest.mark.parametrize("X", [tight(), unit(np.random.default_rng(1).normal(size=(300, 8))), np.ones((50, 4)) / 2], ids=["tight", "random", "equal"])
def test_bins_cuts_and_ends(spark, X, how):
    v = products(X)
    cuts = (0.1, 0.85, 0.999)
    got = pair_stats(vectors_df(spark, X), lo=-1.0, hi=1.0, bins=100, cuts=cuts, **how).collect()
    want = np.bincount(np.clip(np.floor((v + 1) / 0.02), 0, 99).astype(int), minlength=100)
    assert {r.bin: r.n for r in got} == {i: n for i, n in enumerate(want) if n}
    for j, cut in enumerate(cuts):
        assert sum(r[f"n_ge_{j}"] for r in got) == (v >= cut).sum()
    assert abs(sum(r.s for r in got) - v.sum()) < 1e-6
    assert abs(min(r.vmin for r in got if r.vmin is not None) - v.min()) < 1e-12
    assert abs(max(r.vmax for r in got if r.vmax is not None) - v.max()) < 1e-12


def test_tight_groups_are_counted_as_wholes(spark):
    X = tight()
    got = pair_stats(vectors_df(spark, X), lo=-1.0, hi=1.0, bins=100, strategy="grid", rows_per_block=360).collect()
    assert sum(r.n for r in got) == len(X) * (len(X) - 1) // 2
    assert sum(r.examined for r in got) < sum(r.n for r in got) / 3


def test_distribution_is_one_pair_pass(spark):
    X = unit(np.random.default_rng(3).normal(size=(200, 8)))
    df = V.pairwise_distribution(vectors_df(spark, X), "id")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") + plan.count("FlatMapCoGroupsInArrow") == 1
    rows = df.orderBy("bin").collect()
    v = products(X)
    assert [r["count"] for r in rows] == np.histogram(v, 100, (-1, 1))[0].tolist() and rows[-1].cdf == 1.0
    assert V.pairwise_distribution(vectors_df(spark, X[:1]), "id").agg({"count": "sum"}).first()[0] == 0


@pytest.mark.parametrize("how", [{}, {"strategy": "grid", "rows_per_block": 200}, {"strategy": "broadcast"}], ids=str)
@pytest.mark.parametrize("X", [tight(), unit(np.random.default_rng(1).normal(size=(2100, 8))), np.ones((50, 4)) / 2, np.eye(40), 1e-25 * np.eye(9)], ids=["tight", "random", "equal", "zeros", "small"])
def test_counts_in_float32_are_exact(spark, X, how):
    v = products(X)
    df = vectors_df(spark, X)
    lo, hi = (float(v.min()), float(v.max())) if len(X) > 50 else (-1.0, 1.0)
    got = {r.bin: r for r in pair_stats(df, lo=lo, hi=hi, bins=100, sums=False, ends=False, **how).collect()}
    want = np.bincount(np.clip(np.floor((v - lo) / ((hi - lo) / 100)), 0, 99).astype(int), minlength=100)
    assert {i: r.n for i, r in got.items()} == {i: n for i, n in enumerate(want) if n}
    assert all(r.s is None and r.vmin is None for r in got.values())
    cuts = (float(np.sort(v)[-5]), 0.85, 0.999)
    row = pair_stats(df, cuts=cuts, sums=False, **how).first()
    assert row.n == len(v) and [row[f"n_ge_{j}"] for j in range(3)] == [(v >= c).sum() for c in cuts]
    assert abs(row.vmin - v.min()) < 1e-12 and abs(row.vmax - v.max()) < 1e-12


def test_pairs_are_dealt_over_many_tasks(spark):
    from cachelens.operators.vector_join import PairCounts, block_join

    X = unit(np.random.default_rng(5).normal(size=(3000, 8)))
    df = vectors_df(spark, X).coalesce(1)
    part = block_join(df, df, PairCounts(ends=True), q_id="id", d_id="id", triangle=True).collect()
    assert sum(r.n for r in part) == 3000 * 2999 // 2 and len(part) == 6  # three blocks: six pairs of blocks
    assert max(r.examined for r in part) < sum(r.n for r in part) / 3


def test_repeated_and_missing_ids_pair_alike_in_any_grid(spark):
    X = unit(np.random.default_rng(6).normal(size=(60, 8))).astype(np.float32)
    ids = [None if i % 10 == 0 else i // 2 for i in range(60)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, X)], "id long, embedding array<float>")
    key = [-1 if i is None else i for i in ids]
    want = sum(a != b for n, a in enumerate(key) for b in key[:n])
    for how in ({}, {"strategy": "broadcast"}, {"strategy": "grid", "rows_per_block": 20}):
        assert pair_stats(df, sums=False, **how).first().n == want

"""The pruned threshold join against all pairs."""

import numpy as np
import pytest

from cachelens.operators.vectors import threshold_neighbors
from tests.conftest import unit, vectors_df


def clustered(n_centres=40, per=50, dim=16, noise=0.02, seed=1):
    rng = np.random.default_rng(seed)
    return unit(np.repeat(rng.normal(size=(n_centres, dim)), per, axis=0) + noise * rng.normal(size=(n_centres * per, dim)))


def brute(X, threshold):
    X = np.asarray(X, np.float32).astype(np.float64)
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2)
    return ((D <= threshold).sum(axis=1) - 1).tolist()


STRATEGIES = [{"strategy": "broadcast"}, {"strategy": "grid", "rows_per_block": 150}, {"strategy": "grid", "rows_per_block": 60, "n_cells": 3}]


@pytest.mark.parametrize("options", STRATEGIES, ids=str)
def test_counts_of_clustered_rows_and_pairs_examined(spark, options):
    X = clustered()
    got = threshold_neighbors(vectors_df(spark, X), 0.3, examined=True, **options).orderBy("id").collect()
    assert [r.n_within for r in got] == brute(X, 0.3)
    if "n_cells" not in options:
        assert sum(r.n_examined for r in got) < len(X) ** 2 / 3


@pytest.mark.parametrize("options", STRATEGIES, ids=str)
@pytest.mark.parametrize("threshold", [0.0, 0.5, 1.5, 4.0])
def test_counts_of_random_rows(spark, options, threshold):
    X = unit(np.random.default_rng(2).normal(size=(300, 8)))
    X[10] = X[11] = X[12]
    got = threshold_neighbors(vectors_df(spark, X), threshold, **options).orderBy("id").collect()
    want = brute(X, threshold)
    if threshold == 0.0:
        assert [r.n_within for r in got][10:13] == [2, 2, 2]
    assert [r.n_within for r in got] == want or threshold in (0.0, 4.0) and sum(abs(a.n_within - b) for a, b in zip(got, want)) <= 3


def test_a_hot_cell_is_split(spark):
    """Two thirds of all rows are one vector; the others are far away."""
    X = np.vstack([np.tile([1.0, 0, 0, 0], (400, 1)), unit(np.random.default_rng(3).normal(size=(200, 4)))])
    got = threshold_neighbors(vectors_df(spark, X), 0.01, strategy="grid", rows_per_block=50, examined=True).orderBy("id").collect()
    assert [r.n_within for r in got] == brute(X, 0.01)
    assert max(r.n_examined for r in got[:400]) < 600


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, embedding array<float>")
    assert [tuple(r) for r in threshold_neighbors(df, 0.1).orderBy("id").collect()] == [(1, 1), (2, 0), (3, 1)]
    assert threshold_neighbors(df.limit(0), 0.1).collect() == []
    assert [r.n_within for r in threshold_neighbors(df, -1.0).collect()] == [0, 0, 0]

"""Mini-batch k-means against the same steps in plain Python."""

import hashlib

import numpy as np
import pytest

from cachelens.operators import ann
from tests.conftest import unit, vectors_df


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def plain(X, ids, k, batches, epochs, seed=42):
    X = np.asarray(X, np.float32).astype(np.float64)
    order = sorted(range(len(X)), key=lambda i: (md5(seed, "kmeans_init", ids[i]), ids[i]))
    C, seen = X[order[:k]].copy(), np.zeros(k)
    batch = np.array([int(int(md5(seed, "kmeans_batch", i)[:13], 16) / 2**52 * batches) for i in ids])
    for step in range(batches * epochs):
        P = X[batch == step % batches]
        cell = ((P[:, None, :] - C[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            own = P[cell == c]
            if len(own):
                seen[c] += len(own)
                C[c] += (own.sum(axis=0) - len(own) * C[c]) / seen[c]
    return C


@pytest.mark.parametrize("k,batches,epochs", [(5, 4, 2), (3, 1, 1), (8, 3, 1)])
def test_steps(spark, k, batches, epochs):
    rng = np.random.default_rng(1)
    X = unit(np.repeat(rng.normal(size=(5, 12)), 60, axis=0) + 0.2 * rng.normal(size=(300, 12)))
    ids = list(range(7, 307))
    got = ann.kmeans_centers(vectors_df(spark, X, ids=ids), k, batches=batches, epochs=epochs)
    assert np.allclose(got, plain(X, ids, k, batches, epochs), atol=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_more_centres_than_rows(spark):
    with pytest.raises(ValueError):
        ann.kmeans_centers(vectors_df(spark, unit(np.eye(3))), 4)


def test_equal_rows_and_null_vectors(spark):
    df = vectors_df(spark, np.ones((20, 4))).unionByName(spark.createDataFrame([(99, None)], "id long, embedding array<float>"))
    assert np.allclose(ann.kmeans_centers(df, 2), 1.0)

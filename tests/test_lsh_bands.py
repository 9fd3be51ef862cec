"""Banded LSH search and stored code tables against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachelens.operators import ann, lsh
from cachelens.operators.vectors import recall_at_k
from tests.conftest import unit, vectors_df


def rows(n=600, dim=32, seed=0):
    return unit(np.random.default_rng(seed).normal(size=(n, dim)))


def bits_of(X, nbits, seed=42):
    return (np.asarray(X, np.float32).astype(np.float64) @ ann.lsh_hyperplanes(nbits, X.shape[1], seed).T) > 0


def brute(Q, X, k, nbits, bands, radius):
    q, x = bits_of(Q, nbits), bits_of(X, nbits)
    differ = q[:, None, :] != x[None, :, :]
    shared = differ.reshape(len(Q), len(X), bands, nbits // bands).sum(axis=3).min(axis=2) <= radius
    out = []
    for i in range(len(Q)):
        found = sorted((int(differ[i, j].sum()), j) for j in np.flatnonzero(shared[i]))[:k]
        out += [(i, r + 1, j, float(h)) for r, (h, j) in enumerate(found)]
    return out


@pytest.mark.parametrize("nbits,bands,radius,block", [(128, 16, 1, 20_000), (64, 8, 0, 20_000), (64, 16, 0, 25), (128, 16, 1, 10)])
def test_banded_search_equals_its_definition(spark, nbits, bands, radius, block):
    X, Q = rows(), rows(40, seed=1)
    X[300:] = X[5]  # half of all rows in one bucket of every band
    got = lsh.knn_lsh_banded(vectors_df(spark, Q, id_col="query_id"), vectors_df(spark, X), 7, nbits, bands, radius, rows_per_block=block)
    assert sorted(map(tuple, got.collect())) == brute(Q, X, 7, nbits, bands, radius)


def test_recall_against_exhaustive_hamming(spark):
    X, Q = rows(2000, 64), rows(100, 64, seed=2)
    q, d = vectors_df(spark, Q, id_col="query_id"), vectors_df(spark, X)
    recall = {r.k: r.recall for r in recall_at_k(lsh.knn_lsh_banded(q, d, 10), ann.knn_lsh(q, d, 10, nbits=128)).collect()}
    assert recall[10] >= 0.9 and recall[1] >= 0.9


def operators_above(lines, table):
    """From the scan of ``table`` up to the co-group."""
    def depth(line):
        return len(line) - len(line.lstrip(" :+-*"))

    at = next(i for i, line in enumerate(lines) if "Scan" in line and table in line)
    found = [lines[at]]
    for line in reversed(lines[:at]):
        if depth(line) < depth(found[-1]):
            found.append(line)
        if "FlatMapCoGroupsInArrow" in line:
            return found[:-1]
    raise AssertionError("the scan is not under the co-group")


def test_table_is_saved_grown_loaded_and_searched_in_place(spark, tmp_path):
    X, Q = rows(), rows(30, seed=3)
    path = str(tmp_path / "codes")
    lsh.LSHTable.save(vectors_df(spark, X[:400]), path, 64, 8, rows_per_block=50).drop()
    table = lsh.LSHTable.load(spark, path)
    table.append(vectors_df(spark, X[400:], ids=range(400, 600)))
    q = vectors_df(spark, Q, id_col="query_id")
    assert sorted(map(tuple, table.search(q, 5, 1).collect())) == brute(Q, X, 5, 64, 8, 1)
    lines = table.search(q, 5, 1)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Exchange" in line for line in operators_above(lines, table.name))
    gone = spark.range(0, 600, 3)
    table.remove(gone)
    keep = [i for i in range(600) if i % 3]
    number = dict(enumerate(keep))
    want = [(a, r, number[j], h) for a, r, j, h in brute(Q, X[keep], 5, 64, 8, 1)]
    assert sorted(map(tuple, table.search(q, 5, 1).collect())) == want
    small = table.compact(str(tmp_path / "small"))
    assert small.removed.count() == 0 and small.filed.select("id").distinct().count() == len(keep)
    assert sorted(map(tuple, small.search(q, 5, 1).collect())) == want
    table.drop(), small.drop()


def test_nulls_and_nothing(spark):
    X = rows(20, 8)
    d = vectors_df(spark, X).unionByName(spark.createDataFrame([(99, None)], "id long, embedding array<float>"))
    q = vectors_df(spark, X[:2], id_col="query_id")
    assert {r.neighbor_id for r in lsh.knn_lsh_banded(q, d, 3, 64, 8).collect() if r.rank == 1} == {0, 1}
    assert lsh.knn_lsh_banded(q, d.limit(0), 3, 64, 8).collect() == []
    assert lsh.knn_lsh_banded(q.limit(0), d, 3, 64, 8).collect() == []
    with pytest.raises(ValueError):
        lsh.knn_lsh_banded(q, d, 3, 64, 7)

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cachelens.session import get_spark

    s = get_spark(cores=4, shuffle_partitions=4, app="cachelens-tests")
    yield s
    s.stop()


def vectors_df(spark, X, ids=None, id_col="id", vec_col="embedding", extra=None):
    """DataFrame ``(id, embedding ARRAY<FLOAT>)`` from a numpy matrix."""
    ids = list(range(len(X))) if ids is None else list(ids)
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(ids, np.asarray(X, dtype=np.float32))]
    df = spark.createDataFrame(rows, f"{id_col} long, {vec_col} array<float>")
    return df


def unit(X):
    X = np.asarray(X, dtype=np.float64)
    return X / np.linalg.norm(X, axis=1, keepdims=True)

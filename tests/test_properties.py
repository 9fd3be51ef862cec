"""Property tests: range-partitioned ordering helpers equal their single-machine meaning
on random inputs with skewed groups and duplicate order values."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from cachelens.operators.ordering import dense_ids, previous_value, running_sum


@settings(max_examples=4, deadline=None)
@given(n=st.integers(min_value=1, max_value=400), hot=st.floats(min_value=0.0, max_value=0.9),
       parts=st.integers(min_value=1, max_value=9), seed=st.integers(min_value=0, max_value=10_000))
def test_ordering_helpers_match_pandas(spark, n, hot, parts, seed):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < hot, 0, rng.integers(1, 6, n))
    t = rng.integers(0, 20, n)  # repeated order values, made total by the id
    v = rng.integers(-5, 10, n)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "t": t, "v": v})
    df = spark.createDataFrame(pdf)
    exp = pdf.sort_values(["g", "t", "id"]).reset_index(drop=True)
    exp["rn"] = exp.groupby("g").cumcount()
    exp["cum"] = exp.groupby("g")["v"].cumsum() - exp["v"]
    exp["prev"] = exp.groupby("g")["v"].shift(1)
    got_rn = dense_ids(df, ["t", "id"], "rn", num_partitions=parts, partition_by=["g"]).toPandas()
    got_cum = running_sum(df, ["t", "id"], "v", "cum", num_partitions=parts, partition_by=["g"]).toPandas()
    got_prev = previous_value(df, ["g"], ["t", "id"], "v", "prev", num_partitions=parts).toPandas()
    m = exp.merge(got_rn[["id", "rn"]], on="id", suffixes=("", "_s")) \
        .merge(got_cum[["id", "cum"]], on="id", suffixes=("", "_s")) \
        .merge(got_prev[["id", "prev"]], on="id", suffixes=("", "_s"))
    assert len(m) == n
    assert (m.rn == m.rn_s).all() and (m.cum == m.cum_s).all()
    assert m.prev.fillna(-999).equals(m.prev_s.astype("float64").fillna(-999))

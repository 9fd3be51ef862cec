import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cachelens.operators.quantiles import exact_percentiles


def test_exact_percentiles_by_group_and_overall(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 500, p=[0.8, 0.15, 0.05]), "v": np.round(rng.normal(size=500), 1)})
    pdf.loc[::17, "v"] = np.nan
    rows = [(None if g is None or g != g else str(g), None if np.isnan(v) else float(v)) for g, v in zip(pdf.g, pdf.v)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in exact_percentiles(df, F.col("v"), wanted, ["g"]).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        g = g if isinstance(g, str) else None
        for name, p in wanted.items():
            assert abs(got[g][name] - np.quantile(part.v.dropna(), p)) < 1e-12
    row = exact_percentiles(df, F.col("v"), wanted).first()
    assert all(abs(row[n] - np.quantile(pdf.v.dropna(), p)) < 1e-12 for n, p in wanted.items())
    assert exact_percentiles(df.filter("v > 100"), F.col("v"), {"p50": 0.5}).first().p50 is None


def test_percentiles_where_most_rows_hold_one_value(spark):
    """90 % of the rows are zero: they are one row of the value counts, and no partition of what is
    ranked holds more than its share of the distinct values."""
    from cachelens.operators.ordering import running_sum
    from cachelens.operators.quantiles import value_counts

    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), (F.col("id") % 3).alias("g"))
    values = np.array([0.0 if i % 10 else float(i) for i in range(n)])
    wanted = {"p5": 0.05, "p50": 0.5, "p89": 0.89, "p95": 0.95, "p99": 0.99}
    for window_rows in (10**6, 0):
        row = exact_percentiles(df, F.col("v"), wanted, window_rows=window_rows).first()
        assert all(abs(row[k] - np.quantile(values, p)) < 1e-9 for k, p in wanted.items())
        for r in exact_percentiles(df, F.col("v"), wanted, ["g"], window_rows=window_rows).collect():
            assert all(abs(r[k] - np.quantile(values[r.g :: 3], p)) < 1e-9 for k, p in wanted.items())
    counts = value_counts(df, F.col("v"))
    assert counts.count() == n // 10 and counts.agg(F.max("_n")).first()[0] == n * 9 // 10 + 1
    placed = running_sum(counts, ["_v"], "_n", "_before").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert placed < n // 10 / 2

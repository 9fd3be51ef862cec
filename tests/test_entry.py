import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert df.columns == ["threshold", "hit_rate", "retrieval_similarity", "recall_at_1", "distance_quality",
                          "n_hits", "n_misses", "avg_latency_ms", "latency_saving_pct", "avg_cost_usd",
                          "monetary_saving_pct"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100

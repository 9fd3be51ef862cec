from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from cachelens.operators import results as Rs
from cachelens.operators import retention as R
from cachelens.operators import vectors as V
from cachelens.streaming import lookup_stream as st
from tests.conftest import unit, vectors_df


def _log(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, seq long")


def test_lru_victim_is_oldest(spark):
    assert R.rank_lru(_log(spark, [0, 1, 2]), 1).first().key == 0
    assert R.rank_lru(_log(spark, [0, 1, 2, 0]), 1).first().key == 1


def test_lfu_reads_and_ties(spark):
    assert R.rank_lfu(_log(spark, [0, 1, 2, 0, 0, 1]), 1).first().key == 2
    assert R.rank_lfu(_log(spark, [0, 1, 2]), 1).first().key == 0


def _near_copies(rng, isolated=True):
    base = unit(rng.normal(size=(2, 16)))
    cluster = unit(base[0] + 0.01 * rng.normal(size=(3, 16)))
    return np.vstack([base[1:2], cluster]) if isolated else unit(base[0] + 0.01 * rng.normal(size=(4, 16)))


def test_redundancy_isolated_lower_and_victim_clustered(spark):
    X = _near_copies(np.random.default_rng(0))
    ents = vectors_df(spark, X)
    red = {r.id: r.redundancy for r in R.redundancy(ents, 0.30).collect()}
    assert red[0] < min(red[1], red[2], red[3])
    victim = R.rank_semantic(ents, _log(spark, [0, 1, 2, 3]), 0.30, n=1).first().id
    assert victim in (1, 2, 3)


def test_heavy_reads_protect(spark):
    X = _near_copies(np.random.default_rng(1), isolated=False)
    log = _log(spark, [0, 1, 2, 3] + [0] * 100)
    assert R.rank_semantic(vectors_df(spark, X), log, 0.30, n=1).first().id != 0


def test_next_use_furthest_first(spark):
    rng = np.random.default_rng(2)
    E = unit(rng.normal(size=(3, 16)))
    entries = vectors_df(spark, E)
    for order in ([0, 1, 2], [0, 1]):
        stream = vectors_df(spark, E[order], ids=range(len(order)), id_col="query_id") \
            .withColumnRenamed("query_id", "qid")
        stream = stream.withColumn("seq", stream["qid"]).withColumnRenamed("qid", "query_id")
        v = R.next_use_vectors(stream, entries, 0.90, n=1).first()
        assert v.id == 2


def test_next_use_keys_and_registry(spark):
    log = _log(spark, [0, 1, 2, 1, 0])
    nu = {r.key: r.next_use for r in R.next_use_keys(log, cut=3).collect()}
    assert nu == {0: 4.0, 1: 3.0, 2: float("inf")}
    with pytest.raises(ValueError):
        R.rank_victims("fifo", log)
    assert R.rank_victims("none", log).count() == 0


def test_cache_upkeep_bound_and_compaction(spark):
    cache = spark.createDataFrame([(i, True) for i in range(5)], "cache_id long, is_active boolean")
    inserts = spark.createDataFrame([(100 + i,) for i in range(10)], "src_id long")
    out = R.cache_upkeep(cache, inserts, max_size=5).toPandas()
    assert out.is_active.sum() == 5 and len(out) == 15
    assert bool(out.compacted.iloc[0])
    live = out[out.is_active].sort_values("old_id")
    assert list(live.new_id) == list(range(5)) and list(live.old_id) == list(range(10, 15))


def test_one_slot_cache_build(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string")
    out = R.cache_build(rows, "doc_id", max_size=1).collect()
    assert [(r.cache_id, r.doc_id, r.response) for r in out] == [(0, 4, "t4")]


def test_pareto_fronts(spark):
    pts = [(0, 1, 5.0), (1, 2, 4.0), (2, 3, 7.0), (3, 3, 7.0), (4, 4, 6.0), (5, 5, 6.0)]
    df = spark.createDataFrame(pts, "pos long, x long, y double")
    strict = [r.pos for r in Rs.pareto_min_max(df, "x", "y", "pos").orderBy("pos").collect()]
    assert strict == [0, 2]
    nonstrict = [r.pos for r in Rs.pareto_nonstrict(df, "x", "y", "pos").orderBy("pos").collect()]
    assert nonstrict == [0, 2, 3]
    nd = sorted(r.pos for r in Rs.pareto_nondominated(df, "x", "y").collect())
    assert nd == [2, 3, 5]


def _folder(tmp_path, name, pdf, parts=2):
    """A table folder of several files, so that a stream sees several inputs."""
    folder = tmp_path / f"{name}.parquet"
    folder.mkdir()
    for i in range(parts):
        pdf.iloc[i::parts].to_parquet(folder / f"part-{i}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_vector_stream_equals_batch_lookup(spark, tmp_path):
    rng = np.random.default_rng(4)
    X = unit(rng.normal(size=(60, 16)))
    sf = _folder(tmp_path, "vec", pd.DataFrame({"query_id": np.arange(60), "embedding": [x.astype(np.float32) for x in X]}))
    cache = vectors_df(spark, unit(rng.normal(size=(40, 16)))).withColumnRenamed("id", "cache_id")
    live = st.tag_by_vector(st.file_stream(spark, sf, "vec"), cache, 1.2)
    got = {r.query_id: (r.neighbor_id, round(r.dist, 9), r.hit) for r in live.collect()}
    batch = V.lookup(spark.read.parquet(f"{sf}/vec.parquet"), cache, 1, 1.2, active_col=None).collect()
    assert got == {r.query_id: (r.neighbor_id, round(r.dist, 9), r.hit) for r in batch} and len(got) == 60


def test_key_stream_and_hourly_rates_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"key": rng.integers(0, 9, 300), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 5 * 3600, 300)), unit="s")})
    sf = _folder(tmp_path, "acc", pdf)
    cache = spark.createDataFrame([(k, datetime(2024, 1, 1, 2)) for k in range(4)], "key long, since timestamp")
    tags = lambda: st.tag_by_key(st.file_stream(spark, sf, "acc"), cache, "key", "ts", "since")
    got = st.run_to_table(tags(), "t").toPandas()
    want = (got.key < 4) & (got.ts > pd.Timestamp("2024-01-01 02:00:00"))
    assert len(got) == 300 and (got.hit == want).all()
    rates = {r.hour: (r.lookups, r.hits) for r in st.run_updates_to_table(st.hit_rate_by_hour(tags()), "r", ["hour"]).collect()}
    hour = got.ts.astype("datetime64[s]").astype("int64") // 3600
    assert rates == {h: (len(g), int(g.hit.sum())) for h, g in got.groupby(hour)}


def test_redundancy_over_all_entries(spark):
    rng = np.random.default_rng(8)
    X = unit(rng.normal(size=(2300, 6))).astype(np.float32)
    D = ((X[:, None].astype(float) - X[None].astype(float)) ** 2).sum(axis=2)
    want = ((D <= 0.5).sum(axis=1) - 1) / 2299
    got = {r.id: r.redundancy for r in R.redundancy(vectors_df(spark, X), 0.5).collect()}
    assert max(abs(got[i] - want[i]) for i in range(2300)) < 1e-9

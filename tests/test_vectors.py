import numpy as np
import pytest
from pyspark.sql import functions as F

from cachelens.functions.encoder import embed_text
from cachelens.operators import ann
from cachelens.operators import vectors as V
from cachelens.operators.vector_join import knn, pair_stats, range_count
from tests.conftest import unit, vectors_df

STRATEGIES = [{}, {"strategy": "grid", "rows_per_block": 64}]


def _brute_topk(Q, X, k, qids, xids, metric="l2"):
    out = {}
    for i, q in enumerate(Q):
        if metric == "l2":
            d = ((X - q) ** 2).sum(axis=1)
            order = np.lexsort((xids, d))
        else:
            d = X @ q
            order = np.lexsort((xids, -d))
        out[qids[i]] = [int(xids[j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_flat_self_search_and_brute_force(spark, strategy):
    rng = np.random.default_rng(0)
    X = rng.random((300, 32)).astype(np.float32)
    db = vectors_df(spark, X)
    q = vectors_df(spark, X[:40], id_col="query_id")
    res = knn(q, db, 5, **strategy).toPandas()
    for qid in range(5):
        top = res[(res.query_id == qid) & (res["rank"] == 1)].iloc[0]
        assert top.neighbor_id == qid and top.dist < 1e-6
    got = {qid: list(g.sort_values("rank").neighbor_id) for qid, g in res.groupby("query_id")}
    exp = _brute_topk(X[:40].astype(np.float64), X.astype(np.float64), 5, list(range(40)), np.arange(300))
    assert got == exp


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_inner_product_descending(spark, strategy):
    rng = np.random.default_rng(1)
    X = unit(rng.normal(size=(200, 16)))
    res = knn(vectors_df(spark, X[:10], id_col="query_id"), vectors_df(spark, X), 3, metric="ip", **strategy).toPandas()
    got = {qid: list(g.sort_values("rank").neighbor_id) for qid, g in res.groupby("query_id")}
    Xf = X.astype(np.float32).astype(np.float64)
    assert got == _brute_topk(Xf[:10], Xf, 3, list(range(10)), np.arange(200), metric="ip")


def test_fewer_rows_than_k(spark):
    X = unit(np.eye(3, 8))
    res = knn(vectors_df(spark, X, id_col="query_id"), vectors_df(spark, X[:2]), 5).toPandas()
    assert res.groupby("query_id").size().to_dict() == {0: 2, 1: 2, 2: 2}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_range_count_matches_brute_force(spark, strategy):
    rng = np.random.default_rng(2)
    X = unit(rng.normal(size=(150, 8)))
    df = vectors_df(spark, X)
    got = {r.query_id: r.n_within for r in range_count(df, df, 1.0, q_id="id", **strategy).collect()}
    Xf = X.astype(np.float32).astype(np.float64)
    D = ((Xf[:, None, :] - Xf[None, :, :]) ** 2).sum(axis=2)
    exp = ((D <= 1.0).sum(axis=1) - 1)
    assert got == {i: int(exp[i]) for i in range(150)}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_pair_stats_moments(spark, strategy):
    rng = np.random.default_rng(3)
    X = unit(rng.normal(size=(120, 8)))
    df = vectors_df(spark, X)
    row = pair_stats(df, **strategy).agg(F.sum("n"), F.sum("s"), F.min("vmin"), F.max("vmax")).first()
    Xf = X.astype(np.float32).astype(np.float64)
    S = Xf @ Xf.T
    upper = S[np.triu_indices(120, k=1)]
    assert row[0] == len(upper)
    assert abs(row[1] - upper.sum()) < 1e-9 and abs(row[2] - upper.min()) < 1e-12 and abs(row[3] - upper.max()) < 1e-12


def test_validate_embeddings_drops_nan_and_flags_norm(spark):
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    out = {r.id: r.unit_norm for r in V.validate_embeddings(df).collect()}
    assert out == {0: True, 2: False}


def test_lsh_hamming_matches_numpy(spark):
    rng = np.random.default_rng(4)
    X = unit(rng.normal(size=(80, 16)))
    H = ann.lsh_hyperplanes(128, 16, seed=7)
    codes = {r.id: r.code for r in ann.lsh_codes(vectors_df(spark, X), H).collect()}
    bits = (X.astype(np.float32).astype(np.float64) @ H.T) > 0
    for i in (0, 5, 33):
        words = np.array(codes[i], dtype=np.int64).view(np.uint64)
        unpacked = np.array([(int(words[w]) >> b) & 1 for w in range(2) for b in range(64)], dtype=bool)
        assert np.array_equal(unpacked, bits[i])
    res = ann.knn_lsh(vectors_df(spark, X[:5], id_col="query_id"), vectors_df(spark, X), 3, nbits=128, seed=7).toPandas()
    assert (res[res["rank"] == 1].hamming == 0).all()


def test_ivf_full_probe_is_exact_and_partial_probe_recall(spark):
    rng = np.random.default_rng(5)
    centers = unit(rng.normal(size=(6, 16)))
    X = unit(np.repeat(centers, 60, axis=0) + 0.05 * rng.normal(size=(360, 16)))
    db = vectors_df(spark, X)
    q = vectors_df(spark, X[::9], ids=range(0, 360, 9), id_col="query_id")
    idx = ann.IVFIndex.build(db, nlist=6, seed=1)
    exact = knn(q, db, 5)
    full = idx.search(q, 5, nprobe=6)
    rec_full = {r.k: r.recall for r in V.recall_at_k(full, exact).collect()}
    assert rec_full[5] == 1.0
    part = idx.search(q, 5, nprobe=2)
    assert {r.k: r.recall for r in V.recall_at_k(part, exact).collect()}[1] >= 0.9
    with pytest.raises(ValueError):
        ann.knn_index("hnsw", q, db, 5)
    assert ann.list_index_types() == ["flat", "ivf", "lsh"]


def test_ivf_roundtrip_and_add_remove(spark, tmp_path):
    rng = np.random.default_rng(6)
    X = unit(rng.normal(size=(100, 8)))
    db = vectors_df(spark, X[:80])
    idx = ann.IVFIndex.build(db, nlist=4, seed=3)
    idx.save(str(tmp_path / "ivf"))
    back = ann.IVFIndex.load(spark, str(tmp_path / "ivf"), "id")
    q = vectors_df(spark, X[:10], id_col="query_id")
    a = idx.search(q, 3, nprobe=4).orderBy("query_id", "rank").collect()
    b = back.search(q, 3, nprobe=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbor_id) for r in a] == [(r.query_id, r.neighbor_id) for r in b]
    grown = idx.add(vectors_df(spark, X[80:], ids=range(80, 100)))
    assert grown.table.count() == 100
    shrunk = grown.remove(spark.createDataFrame([(i,) for i in range(10)], "id long"))
    assert shrunk.table.count() == 90


def test_recall_handles_missing_queries(spark):
    exact = spark.createDataFrame([(0, 1, 10), (0, 2, 11), (1, 1, 12)], "query_id long, rank int, neighbor_id long")
    approx = spark.createDataFrame([(0, 1, 11), (0, 2, 99)], "query_id long, rank int, neighbor_id long")
    rec = {r.k: r.recall for r in V.recall_at_k(approx, exact, (1, 2)).collect()}
    assert rec == {1: 0.0, 2: 0.25}


def test_encoder_unit_norm_and_similarity(spark):
    df = spark.createDataFrame([(0, "Hello world"), (1, "Test query"), (2, "hello world again"), (3, "")],
                               "id long, text string")
    vecs = {r.id: np.array(r.e) for r in df.select("id", embed_text(F.col("text"), dim=384).alias("e")).collect()}
    for i in (0, 1, 2):
        assert len(vecs[i]) == 384 and abs(np.linalg.norm(vecs[i]) - 1) < 1e-5
    assert vecs[0] @ vecs[2] > vecs[0] @ vecs[1]
    assert np.allclose(vecs[3], 0)


def test_workload_diversity_high_and_low(spark):
    rng = np.random.default_rng(42)
    spread = vectors_df(spark, rng.normal(size=(500, 32)))
    centers = rng.normal(size=(3, 32))
    tight = vectors_df(spark, np.repeat(centers, 100, axis=0) + 0.01 * rng.normal(size=(300, 32)))
    hi = V.workload_diversity(spread, label_col=None).first().pair_diversity
    lo = V.workload_diversity(tight, label_col=None).first().pair_diversity
    assert hi > 0.7 and lo < 0.75 and lo < hi


def test_broadcast_database_strategy_matches(spark):
    rng = np.random.default_rng(9)
    X = rng.random((120, 16))
    Qm = rng.random((60, 16))
    db, q = vectors_df(spark, X), vectors_df(spark, Qm, id_col="query_id")
    a = knn(q, db, 4).orderBy("query_id", "rank").collect()
    b = knn(q, db, 4, strategy="broadcast_database").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbor_id) for r in a] == [(r.query_id, r.neighbor_id) for r in b]
    c = knn(q, db, 4, max_broadcast_rows=10).orderBy("query_id", "rank").collect()  # both sides above the bound: grid
    assert [(r.query_id, r.neighbor_id) for r in a] == [(r.query_id, r.neighbor_id) for r in c]
    cnt_a = {r.query_id: r.n_within for r in range_count(q, db, 1.5, exclude_self=False).collect()}
    cnt_b = {r.query_id: r.n_within for r in range_count(q, db, 1.5, exclude_self=False, strategy="broadcast_database").collect()}
    assert cnt_a == cnt_b


def test_pairwise_over_more_than_two_thousand_rows(spark):
    """All pairs count: closed-form moments, block extremes and shares against numpy."""
    rng = np.random.default_rng(11)
    X = unit(rng.normal(size=(2100, 6))).astype(np.float32)
    df = vectors_df(spark, X)
    S = (X.astype(float) @ X.T.astype(float))[np.triu_indices(2100, 1)]
    row = V.pairwise_cosine(df, "id").first()
    assert row.n_pairs == len(S)
    for got, want in ((row["mean"], S.mean()), (row["std"], S.std()), (row["min"], S.min()), (row["max"], S.max())):
        assert abs(got - want) < 1e-5
    shares = {r.cut: r.share_ge for r in V.pairwise_cdf(df, "id").collect()}
    assert all(abs(shares[c] - (S >= c).mean()) < 1e-5 for c in shares)
    hist = V.pairwise_histogram(df, "id").toPandas()
    assert hist["count"].sum() == len(S)


def test_coverage_uses_the_whole_stream(spark):
    rng = np.random.default_rng(12)
    X, C = unit(rng.normal(size=(2200, 6))), unit(rng.normal(size=(30, 6)))
    row = V.semantic_coverage(vectors_df(spark, X, id_col="query_id"), vectors_df(spark, C, id_col="cache_id")).first()
    want = ((X.astype(np.float32).astype(float)[:, None] - C.astype(np.float32).astype(float)[None]) ** 2).sum(axis=2).min(axis=1).mean()
    assert row.n_rows == 2200 and abs(row.semantic_coverage_avg_dist - want) < 1e-6


def test_more_cells_than_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="nlist"):
        ann.IVFIndex.build(vectors_df(spark, unit(np.random.default_rng(1).normal(size=(5, 4)))), nlist=6)


def test_failing_backend_gives_an_error_row(spark, monkeypatch):
    """An error while the search runs, not only one while it is planned."""
    from pyspark.sql import functions as F

    from cachelens.plans import evaluation as EV

    real = ann.knn_index

    def breaks(kind, *a, **kw):
        out = real(kind, *a, **kw)
        return out.withColumn("dist", F.raise_error(F.lit("lost")).cast("double")) if kind == "ivf" else out

    monkeypatch.setattr(EV.ann, "knn_index", breaks)
    emb = vectors_df(spark, unit(np.random.default_rng(2).normal(size=(60, 8))), id_col="vec_id")
    rows = EV.backend_comparison(emb, (("flat", {}), ("ivf", {"nlist": 4, "nprobe": 2}))).toPandas()
    assert (rows.backend == "flat").sum() == 15
    bad = rows[rows.backend == "ivf"]
    assert len(bad) == 1 and "lost" in bad.error.iloc[0] and bad.strategy.iloc[0] == "random"


def test_benchmark_with_trained_centres_workloads_and_error_rows(spark):
    from cachelens.plans import evaluation as EV

    rng = np.random.default_rng(3)
    X = unit(np.repeat(unit(rng.normal(size=(6, 16))), 40, axis=0) + 0.3 * rng.normal(size=(240, 16)))
    emb = vectors_df(spark, X, id_col="vec_id")
    rows = EV.knn_benchmark(emb, ivf_grid=[(6, 1), (6, 6), (4096, 16)], lsh_grid=[64]).toPandas()
    assert set(rows.workload) == {"uniform", "clustered", "bursty"} and len(rows) == 5 * 3
    ivf = rows[(rows.index_type == "ivf") & rows.error.isna()]
    assert (ivf[ivf.params.map(lambda p: p["nprobe"]) == 6].recall_at_10 == 1.0).all()
    assert (ivf[ivf.params.map(lambda p: p["nprobe"]) == 1].recall_at_10 > 0.4).all()
    assert rows[rows.params.map(lambda p: p.get("nlist") == 4096)].error.str.contains("nlist").all()


def test_benchmark_grid_against_brute_force(spark):
    """Every IVF and LSH setting and every workload on a small table, worked out in numpy."""
    from cachelens.operators import ann
    from cachelens.plans import evaluation as EV

    rng = np.random.default_rng(5)
    X = unit(np.repeat(unit(rng.normal(size=(8, 16))), 25, axis=0) + 0.4 * rng.normal(size=(200, 16))).astype(np.float32).astype(float)
    emb = vectors_df(spark, X, id_col="vec_id")
    ivf, lsh = [(4, 1), (4, 3), (16, 2), (16, 5), (300, 4)], [64, 192]
    got = {(r.index_type, tuple(sorted(r.params.items())), r.workload): r for r in EV.knn_benchmark(emb, ivf_grid=ivf, lsh_grid=lsh).collect()}
    assert len(got) == (1 + len(ivf) + len(lsh)) * 3
    split = EV.holdout_split(emb, id_col="vec_id").select("vec_id", "split").toPandas().set_index("vec_id").split
    q, d = ([i for i in range(200) if split[i] == side] for side in ("query", "database"))
    D = ((X[q][:, None] - X[d][None]) ** 2).sum(axis=2)

    def nearest(scores, allowed=None):
        return [[d[j] for j in sorted((j for j in range(len(d)) if allowed is None or allowed[i, j]), key=lambda j: (row[j], d[j]))[:10]] for i, row in enumerate(scores)]

    truth = nearest(D)
    db = emb.join(spark.createDataFrame([(i,) for i in d], "vec_id long"), "vec_id")
    found = {("flat", ()): truth}
    for nlist, nprobe in ivf[:-1]:
        C = ann.kmeans_centers(db, nlist, 42, id_col="vec_id")
        near = np.argsort(((X[:, None] - C[None]) ** 2).sum(axis=2), axis=1, kind="stable")
        allowed = (near[d][:, 0][None, :, None] == near[q][:, None, :nprobe]).any(axis=2)
        found["ivf", (("nlist", float(nlist)), ("nprobe", float(nprobe)))] = nearest(D, allowed)
    for nbits in lsh:
        bits = (X @ ann.lsh_hyperplanes(nbits, 16, 42).T) > 0
        found["lsh", (("nbits", float(nbits)),)] = nearest((bits[q][:, None] != bits[d][None]).sum(axis=2))
    split_rows = EV.holdout_split(emb.select("vec_id", "embedding"), id_col="vec_id")
    sides = [split_rows.filter(f"split = '{side}'") for side in ("query", "database")]
    for workload in EV.WORKLOADS:
        w = dict.fromkeys(q, 1) if workload == "uniform" else {r.query_id: r.w for r in EV.workload_weights(*sides, workload, "vec_id", 42).collect()}
        for (kind, params), lists in found.items():
            for k in (1, 5, 10):
                share = [len(set(a[:k]) & set(t[:k])) / k for a, t in zip(lists, truth)]
                want = sum(s * w.get(i, 0) for s, i in zip(share, q)) / sum(w.values())
                assert abs(got[kind, params, workload][f"recall_at_{k}"] - want) < 2e-6
        bad = got["ivf", (("nlist", 300.0), ("nprobe", 4.0)), workload]
        assert "nlist" in bad.error and bad.recall_at_10 is None


def test_benchmark_where_every_search_fails(spark, monkeypatch):
    from cachelens.plans import evaluation as EV

    emb = vectors_df(spark, unit(np.random.default_rng(0).normal(size=(40, 8))), id_col="vec_id")
    real = EV.materialize
    monkeypatch.setattr(EV, "materialize", lambda df, name="table": 1 / 0 if name == "bench-approx" else real(df, name))
    rows = EV.knn_benchmark(emb, ivf_grid=[(2, 1)], lsh_grid=[64], workloads=("uniform",)).collect()
    assert len(rows) == 3 and all("division" in r.error and r.recall_at_1 is None for r in rows)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_float32_scores_keep_the_exact_result(spark, metric):
    """Neighbours that differ in the last bits of float32 are told apart."""
    rng = np.random.default_rng(7)
    base = unit(rng.normal(size=(1, 24)))
    X = (base + 1e-6 * rng.normal(size=(400, 24))).astype(np.float32)
    Q = (base + 1e-6 * rng.normal(size=(5, 24))).astype(np.float32)
    x, q = X.astype(float), Q.astype(float)
    score = -(q @ x.T) if metric == "ip" else ((q[:, None] - x[None]) ** 2).sum(axis=2)
    for how in ({}, {"strategy": "grid", "rows_per_block": 50}):
        got = knn(vectors_df(spark, Q, id_col="query_id"), vectors_df(spark, X), 7, metric=metric, **how).collect()
        for i in range(5):
            own = [r.neighbor_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i]
            assert np.allclose(score[i][own], np.sort(score[i])[:7], atol=1e-15)


def test_cache_stats_with_lookup_times(spark):
    cache = spark.createDataFrame([(i, i % 3 != 0) for i in range(10)], "cache_id long, is_active boolean")
    log = spark.createDataFrame([(1, True, 2.0), (2, False, 4.0)], "query_id long, hit boolean, ms double")
    row = V.cache_stats(cache, log, latency_col="ms").first()
    assert (row["size"], row.total_inserts, row.total_evictions, row.total_hits, row.avg_lookup_ms) == (6, 10, 4, 1, 3.0)


def test_matrices_of_a_task_do_not_grow_with_the_batch(spark):
    import tracemalloc

    import pyarrow as pa
    from cachelens.operators import ann
    from cachelens.operators.vectors import assign_nearest

    class Captured(Exception):
        pass

    rng = np.random.default_rng(0)
    X, C = rng.normal(size=(10_000, 16)).astype(np.float32), rng.normal(size=(4096, 16))
    df = vectors_df(spark, X[:2])

    class Rows:
        sparkSession, schema = df.sparkSession, df.schema

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            raise Captured(fn)

    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(10_000), pa.int64()), "embedding": pa.array(list(X), pa.list_(pa.float32()))})
    for step in (lambda: assign_nearest(Rows(), C), lambda: ann.batch_sums(Rows(), C, "id", "embedding"), lambda: ann.lsh_codes(Rows(), rng.normal(size=(1536, 16)))):
        with pytest.raises(Captured) as found:
            step()
        fn = found.value.args[0]
        tracemalloc.start()
        for _ in fn(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20

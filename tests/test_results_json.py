"""Benchmark-result JSON in three layouts (flat list, {"results": ...}, {"runs": ...})."""

import json

from cachelens.plans import evaluation as EV
from cachelens.sources.tables import scan_benchmark_results


def _run(index_type, recall, params=None, error=None, label="x"):
    return {"index_type": index_type, "params": params or {}, "dataset_size": 100, "dataset_label": label,
            "workload": "uniform", "recall_at_1": recall, "recall_at_5": recall, "recall_at_10": recall,
            "error": error}


def test_three_layouts_labels_and_errors(spark, tmp_path):
    (tmp_path / "index_benchmark_10k.json").write_text(json.dumps(
        [_run("flat", 1.0), _run("ivf", 0.8, {"nlist": 64.0, "nprobe": 4.0}), _run("ivf", None, error="boom")]))
    (tmp_path / "index_benchmark_50k.json").write_text(json.dumps(
        {"results": [_run("ivf", 0.7, {"nlist": 64.0, "nprobe": 4.0}), _run("ivf", 0.9, {"nlist": 64.0, "nprobe": 16.0})]}))
    (tmp_path / "index_benchmark_full.json").write_text(json.dumps(
        {"runs": [_run("lsh", 0.5, {"nbits": 64.0})]}))
    (tmp_path / "index_benchmark_empty.json").write_text(json.dumps({"runs": [_run("flat", None, error="x")]}))
    rows = scan_benchmark_results(spark, str(tmp_path / "index_benchmark_*.json"))
    got = sorted((r.dataset_label, r.index_type, r.recall_at_10) for r in rows.collect())
    assert got == [("10k", "flat", 1.0), ("10k", "ivf", 0.8), ("50k", "ivf", 0.7), ("50k", "ivf", 0.9),
                   ("full", "lsh", 0.5)]
    best = EV.best_config(rows, "ivf").first()
    assert best.recall_at_10 == 0.9 and best.params["nprobe"] == 16.0
    fallback = EV.best_config(rows, "hnsw").first()
    assert fallback.index_type == "hnsw" and fallback.recall_at_10 == 0.0
    series = {r["nlist"]: [p["nprobe"] for p in r.series]
              for r in EV.parameter_sensitivity(rows).filter("dataset_label = '50k'").collect()}
    assert series == {64.0: [4.0, 16.0]}


def test_best_row_prices_the_cost_model(spark, tmp_path):
    from cachelens.functions.cost import CostModel

    run = _run("ivf", 0.9, {"nlist": 64.0}) | {"search_latency_ms": {"p50": 2.5, "p95": 9.0}, "build_time_s": 3.0, "memory_mb": 10.0}
    (tmp_path / "index_benchmark_10k.json").write_text(json.dumps({"results": [run, _run("ivf", 0.5)]}))
    rows = scan_benchmark_results(spark, str(tmp_path / "index_benchmark_*.json"))
    best = EV.best_config(rows, "ivf").first()
    assert best.build_time_s == 3.0 and CostModel.from_best(best).cache_latency_ms == 2.5
    assert CostModel.from_best(EV.best_config(rows, "lsh").first()).cache_latency_ms == CostModel().cache_latency_ms


def test_run_records_roundtrip_and_layout(spark, tmp_path):
    from cachelens.sources.run_records import checkpoint_rows, scan_run_records

    run = {"seed": 1, "workload": "temporal", "final_hit_rate": 0.25, "semantic_coverage_avg_dist": 0.5, "timing": {"stream_time_s": 2.0},
           "cache_stats": {"n_evictions": 7}, "cumulative_hit_rates": [{"query_idx": 500, "cumulative_hit_rate": 0.2, "rolling_hit_rate": 0.3, "evictions": 4}]}
    doc = {"config": {"policies": ["lru"]}, "per_seed": {"lru": {"0.10": [run, run | {"seed": 2}]}, "lfu": {"0.05": [run]}}}
    (tmp_path / "eviction_results.json").write_text(json.dumps(doc, indent=1))
    rows = scan_run_records(spark, str(tmp_path / "eviction_results.json"))
    got = sorted((r.policy, r.cache_size_pct, r.seed, r.n_evictions, r.stream_time_s) for r in rows.collect())
    assert got == [("lfu", 0.05, 1, 7, 2.0), ("lru", 0.1, 1, 7, 2.0), ("lru", 0.1, 2, 7, 2.0)]
    assert checkpoint_rows(rows).count() == 3

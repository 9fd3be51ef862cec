"""Plan guards: registered queries never plan a cartesian product or a nested-loop join,
and the flagship scans only the columns it needs."""

import re

import pytest

import __spark_entry__ as E
from cachelens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
#: Joins of one-row aggregates; nothing else may be planned as a product.
ONE_ROW = {"pairwise_cosine", "distance_analysis", "evaluation_bundle"}
TEXT_SORTS = {"dedup_exact", "preprocess", "length_filter", "dense_ids", "first_user_turn", "fixed_subsets", "embedding_subsets",
              "frequency_summary", "dataset_summary", "preprocess_funnel"}


#: These only read the result of ``knn_benchmark``, which they run as a whole.
ON_BENCHMARK = {"best_config", "parameter_sensitivity", "scaling_series", "row_expectations", "scan_benchmark_results",
                "knn_benchmark_grid"}  # the grid has a test of its own


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ON_BENCHMARK))
def test_plan_and_leftovers(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    if name not in ONE_ROW:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "percentile(" not in plan or name in {"length_stats", "turn_stats"}  # whole numbers: few distinct values
    if name in TEXT_SORTS:
        assert "SortAggregate" not in plan
        assert not re.search(r"Expand \[\[[^\]]*text#", plan)  # no copies of whole texts
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_flagship_prunes_columns_and_scans_in_arrow_blocks(spark):
    df = E.queries()["threshold_sweep"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "label" not in plan.split("ReadSchema")[1].split("\n")[0]

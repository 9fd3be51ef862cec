"""Registered queries over the driver tables, each with its DuckDB oracle when SQL can say it.

Every query reads whole tables (no id subsets, no row caps) and returns a lazy DataFrame
whose column names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cachelens.session import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


# Importing the query modules fills the registry.
from cachelens.plans import q_misc, q_results, q_retention, q_routing, q_sampling, q_text, q_vectors  # noqa: E402,F401

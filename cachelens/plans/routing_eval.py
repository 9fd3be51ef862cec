"""Routing evaluation plans: split -> exact nearest neighbour -> sweep / calibration / analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators import routing
from cachelens.operators.sampling import fill_split, holdout_split
from cachelens.operators.vector_join import knn


def nn_table(queries: DataFrame, database: DataFrame, *, q_id: str, d_id: str,
             vec: str = "embedding", approx: DataFrame | None = None, **strategy) -> DataFrame:
    """``(query_id, nn_id, dist, gt_id, gt_dist)``: nearest cache entry per query.

    ``approx`` (a k=1 result of an approximate search with the same columns as
    :func:`knn`) provides ``nn_*``; the exact search always provides ``gt_*``. Queries
    without any neighbour keep ``dist = null``."""
    exact = knn(queries, database, 1, q_id=q_id, q_vec=vec, d_id=d_id, d_vec=vec, **strategy) \
        .select("query_id", F.col("neighbor_id").alias("gt_id"), F.col("dist").alias("gt_dist"))
    ids = queries.select(F.col(q_id).cast("long").alias("query_id"))
    out = ids.join(exact, "query_id", "left")
    if approx is None:
        return out.withColumn("nn_id", F.col("gt_id")).withColumn("dist", F.col("gt_dist"))
    a = approx.filter(F.col("rank") == 1).select("query_id", F.col("neighbor_id").alias("nn_id"),
                                                    F.col("dist").alias("dist"))
    return out.join(a, "query_id", "left")


def holdout_nn(emb: DataFrame, id_col: str = "vec_id", query_count: int = 1000, seed: int = 42,
               **strategy) -> DataFrame:
    """C6 holdout split then exact k=1 search of the held-out queries in the rest."""
    split = holdout_split(emb.select(id_col, "embedding"), id_col=id_col,
                          query_count=query_count, seed=seed)
    q = split.filter(F.col("split") == "query")
    db = split.filter(F.col("split") == "database")
    return nn_table(q, db, q_id=id_col, d_id=id_col, **strategy)


def fill_nn(emb: DataFrame, id_col: str = "vec_id", strategy: str = "random", ratio: float = 0.5,
            seed: int = 42, **kw) -> DataFrame:
    """C7 cache/eval split then exact k=1 search of eval rows in the cache part."""
    cols = [id_col, "embedding"] + (["frequency"] if "frequency" in emb.columns else [])
    parts = fill_split(emb.select(*cols), id_col=id_col, ratio=ratio, strategy=strategy, seed=seed)
    cache = parts.filter(F.col("part") == "cache")
    ev = parts.filter(F.col("part") == "eval")
    return nn_table(ev, cache, q_id=id_col, d_id=id_col, **kw)


def flagship(emb: DataFrame, thresholds=routing.DEFAULT_THRESHOLDS) -> DataFrame:
    """Holdout split -> exact kNN (k=1) -> threshold sweep with savings."""
    return routing.threshold_sweep(holdout_nn(emb), thresholds)

"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``a < b`` links: the neighbours of a node move to its smallest one.

    ``large`` looks at all neighbours and moves the larger ones; otherwise the smaller ones
    move. Minima are aggregated before the shuffle; no neighbour list is gathered.
    """
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("m").alias("x"), F.col("v").alias("y"))
    else:
        moved = joined.select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y"))
    return moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of the links ``a, b``.

    Each round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, state = materialize(edges, "links"), None
    while True:
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got[0] == 0 or tuple(got) == state:
            break
        state = tuple(got)
        edges = materialize(_star(_star(edges, True), False), "links")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

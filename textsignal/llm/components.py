"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsignal.sources.tables import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Each kept neighbour of a node, linked to the smallest of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    return linked.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.filter("u <> m").select("u", F.col("m").alias("v"))
    ).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of the edges (``u, v``, longs) but the smallest of its component, and that smallest.

    Large and small stars in turn, until every edge points to a root: a number of rounds that
    grows with the logarithm of the nodes. Tables are written each round; only two sums
    reach the driver.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        large = cut_lineage(_star(_both(now), "v > u"), "edges")
        now = cut_lineage(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "v < u"), "edges")
        found = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if found == mark:
            return now
        mark = found

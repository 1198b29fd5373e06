"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Stored

SHARE = 500


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """Each edge with ``m``, the least neighbour of its node a or that node itself.

    Minima come from a map-side aggregate.  Nodes with a 500th of all edges or more, a thousand at most, get theirs by
    broadcast, so the edges of such a node stay spread; those of all others meet their minimum by a shuffle.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") >= max(64, rows // SHARE)
    hubs = F.broadcast(least.filter(hub).select("a", "m"))
    others = edges.join(hubs.select("a"), "a", "left_anti").join(least.filter(~hub).select("a", "m"), "a")
    return edges.join(hubs, "a").union(others)


def components(edges: DataFrame, stored: Stored) -> DataFrame:
    """From (a, b) to (node, root): every node with the least node of its component.

    Alternates two star steps: every node's larger neighbours are tied to its least neighbour, then every
    node's smaller neighbours.  Both join a minimum per node back to the edges, so a node of any degree is only
    aggregated, and rows never exceed the edges.  Each round is a stored table; rounds grow with the logarithm
    of the longest path, and one number per round comes to the driver.
    """
    cut = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = stored.put(cut), None
    rows = now.count()
    while True:
        both = _with_least(now.union(now.select("b", "a")), 2 * rows)
        large = both.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, rows).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored.put(small.filter("a <> b").distinct(), replaces=1)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

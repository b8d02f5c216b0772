"""Connected components over a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialize


#: A node with more edges than this, and than one in MOST_HUBS of all edges, is a hub.
HUB, MOST_HUBS = 256, 4096


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of its u; total is at least the number of edges.

    Only the least neighbour meets at u. Edges of hubs get it where they lie, by a broadcast of fewer than MOST_HUBS rows,
    as hubs have more than one in MOST_HUBS of the edges each; all others by a join, where no key has more rows than that.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    limit = max(HUB, total // MOST_HUBS)
    hubs = low.where(F.col("n") > limit).select("u", "m")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest node.

    Edges are pairs of longs in any order, repeated or not; null ends and loops are ignored. Each round is groupBy-min
    and equi-joins (no neighbour list is gathered, and a hub's edges do not meet, see _with_least), written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain. Only two numbers a round come to the driver.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "stars")
        ends = _with_least(large, before[0])
        small = ends.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(ends.where("v = m").select("u", "v")).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

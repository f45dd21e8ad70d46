"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_least(edges: DataFrame, lane_edges: int) -> DataFrame:
    """``edges`` (a, b) with m, the smallest of a and its neighbours b.

    The smallest is a grouped minimum, which combines before the shuffle; it goes back to the edges of a hub in as many lanes as the hub has
    parts of ``lane_edges`` edges. Hubs are no more than the edges divided by ``lane_edges``.
    """
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.ceil(F.count("*") / lane_edges).cast("int").alias("lanes"))
    hubs = least.where("lanes > 1").select("a", "lanes")
    dealt = edges.join(F.broadcast(hubs), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("lanes", F.lit(1))).cast("int").alias("lane"))
    return dealt.join(least.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")), ["a", "lane"]).select("a", "b", "m")


def star_components(edges: DataFrame, write, lane_edges: int = 100_000) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b); an edge from a node to itself makes it a node alone.

    A large star links the larger neighbours of each node to its smallest one, a small star the smaller neighbours and the node itself; stars
    alternate until nothing changes, in a number of rounds that grows with the square of the logarithm of the nodes at most.
    ``write(df, name)`` writes a table and reads it back, so a round is not computed again in the next.
    """
    now = write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")  # a >= b; all edges of the rounds go down
    alone = now.where("a = b").select("a")
    now, state = now.where("a <> b"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, lane_edges).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = write(large, "large-star")
        near = _with_least(large, lane_edges)
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(near.select("a", F.col("m").alias("b"))).distinct()
        now = write(small, "small-star")
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = now.select("b").unionByName(alone.select(F.col("a").alias("b"))).distinct().join(now.select(F.col("a").alias("b")), "b", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))

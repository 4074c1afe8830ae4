"""Connected components of a distributed edge list, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Each round points
    every node at the smallest of itself and its neighbours and contracts the edges along these
    pointers, so the edges shrink geometrically and nothing but counts reaches the driver. Null ends
    are ignored; repeated edges and loops do no harm; without edges there are no rows."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live = materialize(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialize(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hop = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        first = materialize(hop, "hop")
        # a node's pointer may itself point on: follow it once more
        on = first.select(F.col("v").alias("p"), F.col("p").alias("p2"))
        hop = materialize(first.join(on, "p").select("v", F.col("p2").alias("p")), "hop")
        left = hop.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hop.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        fewer = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        to = hop.select(F.col("v").alias("component"), F.col("p").alias("next"))
        pointed = materialize(
            labels.join(to, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels"
        )
        for done in (first, hop, live, labels):
            release(done)
        live, labels = fewer, pointed
    return labels

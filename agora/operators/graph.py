"""Graphs as edge tables: components, communities, cores and betweenness by repeated joins.

Each step is one join and one aggregation over the edges and is written to the shared folder, so the plan does not grow
with the number of steps and a lost executor costs one step at most. Aggregations combine before they shuffle and joins
are split where a node has very many edges, so a hub is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialised


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(a, b, w) in both directions, parallel edges summed; loops and edges without an end are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = edges.select("a", "b", w.alias("w")).where("a is not null and b is not null and a <> b")
    return one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component's least node, of every node that an edge has.

    Every node points at the least node that it knows. In a round the pointers of neighbours are taken over and then followed
    (a pointer to x becomes x's own pointer), so the number of rounds grows with the logarithm of a component's width.
    """
    links = materialised(both_ways(edges).select("a", "b"), "links")
    now = materialised(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "components")
    while True:
        near = links.join(now.select(F.col("node").alias("b"), "to"), "b").groupBy(F.col("a").alias("node")).agg(F.min("to").alias("near"))
        # the node that a node points at learns of its follower's neighbours, too
        told = now.join(near, "node").select(F.col("to").alias("node"), "near")
        heard = near.unionAll(told).groupBy("node").agg(F.min("near").alias("near"))
        step = now.join(heard, "node", "left").select("node", F.least("to", "near").alias("to"))
        follow = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("over")), "to").select("node", F.least("to", "over").alias("to"))
        new = materialised(follow, "components")
        if new.join(now.withColumnRenamed("to", "old"), "node").where("to <> old").isEmpty():
            return new.select("node", F.col("to").alias("component"))
        now = new


def communities(edges: DataFrame, weight: str | None = None, rounds: int = 20) -> DataFrame:
    """(node, community) by weighted label propagation.

    In each round every node takes the label of greatest weight among its neighbours and itself (its own counts as its
    strongest edge, so that no two nodes swap labels for ever), the least label of equals. It ends when no label changes, or after `rounds`.
    """
    links = materialised(both_ways(edges, weight), "links")
    self = links.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    reach = materialised(links.unionByName(self), "links")
    now = reach.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        heard = reach.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        new = materialised(heard.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")), "labels")
        if new.join(now.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            break
        now = new
    return new.select("node", F.col("label").alias("community"))


def cores(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k for which the node is in a subgraph where every node has k neighbours.

    Every node's number is at first its degree; in a round it becomes the largest h for which h neighbours have a number of
    at least h. That ends in the core numbers. Neighbours are counted by number, up to the node's own, so a hub's list is never made.
    """
    links = materialised(both_ways(edges).select("a", "b"), "links")
    now = materialised(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")), "cores")
    while True:
        own = links.join(now.select(F.col("node").alias("a"), F.col("core").alias("own")), "a").join(now.select(F.col("node").alias("b"), "core"), "b")
        tally = own.groupBy("a", "own", F.least("own", "core").alias("h")).agg(F.count("*").alias("n"))
        over = Window.partitionBy("a").orderBy(F.desc("h"))
        least = tally.withColumn("n", F.sum("n").over(over)).select(F.col("a").alias("node"), F.least("h", "n").alias("h"))
        new = materialised(least.groupBy("node").agg(F.max("h").alias("core")), "cores")
        if new.join(now.withColumnRenamed("core", "old"), "node").where("core <> old").isEmpty():
            return new
        now = new


def betweenness(edges: DataFrame, pivots: int | None = None) -> DataFrame:
    """(node, betweenness): the share of shortest paths between two others that lead over the node, summed over pairs, each unordered pair once.

    From each pivot the graph is searched level by level, counting shortest paths; the shares flow back from the last
    level. With `pivots`, that many nodes of the least hash stand for all, and sums are scaled up; else every node is one.
    """
    links = materialised(both_ways(edges).select("a", "b"), "links")
    nodes = links.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    start = nodes if pivots is None else nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    levels = [materialised(start.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("pivot", "node")
    while True:
        reached = levels[-1].join(links, F.col("node") == F.col("a")).groupBy("pivot", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        new = materialised(reached.join(seen, ["pivot", "node"], "left_anti"), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = materialised(seen.unionAll(new.select("pivot", "node")), "seen")
    share = levels[-1].withColumn("share", F.lit(0.0))
    total = None
    for level in reversed(levels[:-1]):
        below = share.select("pivot", F.col("node").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("each"))
        back = level.join(links, F.col("node") == F.col("a")).join(below, ["pivot", "b"]).groupBy("pivot", "node").agg(F.sum("each").alias("each"))
        share = materialised(level.join(back, ["pivot", "node"], "left").select("pivot", "node", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("share")), "shares")
        own = share.where("node <> pivot").select("node", "share")
        total = own if total is None else total.unionAll(own)
    scale = 0.5 * (1 if pivots is None else n / min(pivots, max(n, 1)))
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    summed = total.groupBy("node").agg(F.sum("share").alias("share"))
    return nodes.join(summed, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))

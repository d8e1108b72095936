"""Connected components of an edge table, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import discard, materialize

#: Nodes of more than HEAVY_ROWS edges and a HEAVY_NODES-th of all of them are sent to all tasks: 2 * HEAVY_NODES of them at most.
HEAVY_ROWS, HEAVY_NODES = 500, 500_000


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b: long), by large-star and small-star rounds.

    Each round reattaches neighbours to the smallest one known, until all components are stars; all steps are grouped minima, combined before the
    shuffle, and joins in which one side has a row for each node. Where a node has very many neighbours, such nodes are sent to all tasks, so that no
    task gathers one's edges. Edges that are stars already take no round. Tables of earlier rounds are deleted.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while (state := shape(pairs))["inner"]:
        limit = max(HEAVY_ROWS, state["edges"] // HEAVY_NODES)
        limit = limit if state["most"] > limit else None
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = met(both.where("b > a"), least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = met(large, least, limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(large, pairs)
        pairs = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def met(edges: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """edges (a, b) with m of least (a, m, n: a node's edges); nodes of more than limit edges are sent, if there are any."""
    if limit is None:
        return edges.join(least.select("a", "m"), "a")
    heavy = F.col("n") > limit
    both = edges.join(F.broadcast(least.where(heavy).select("a", "m")), "a", "left")
    rest = both.where("m is null").select("a", "b").join(least.where(~heavy).select("a", "m"), "a")
    return both.where("m is not null").unionByName(rest)


def shape(pairs: DataFrame) -> dict[str, int]:
    """edges of pairs (a, b: b < a), the most that a node has, and inner: nodes with a smaller neighbour that isn't the only one or has a smaller one
    itself; components without such nodes are stars."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0")).alias("inner"), F.sum("up").alias("edges"), F.max(F.col("up") + F.col("down")).alias("most")).first().asDict()

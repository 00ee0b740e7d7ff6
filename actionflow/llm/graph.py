"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionflow.llm.scratch import hot_keys, written


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """Edges (u, v) with the m of their u.

    What hubs have to know comes to their edges by broadcast (``hot_keys``: few by
    arithmetic), so that no task gets all edges of a hub.
    """
    hubs = hot_keys(edges, "u", many).join(least, "u").select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    split = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    others = split.where("hub IS NULL").select("u", "v").join(least, "u").select("u", "v", "m")
    return split.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(others)


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its least node.

    edges: two bigint columns u and v. Alternates large-star and small-star steps,
    which take a number of rounds logarithmic in the longest path; every step is a
    table in the shared folder. It ends when a round gives the edges it got, which is
    held row by row. Minima are partial on the map side; edges of a node with very
    many find its minimum by broadcast.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    many = edges.count()
    while many:  # a step makes no more edges than it gets
        large = written(_large_star(edges, many), "large_stars", many)
        new = written(_small_star(large, many), "small_stars", many)
        now = new.count()
        done = now == many and new.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0
        edges, many = new, now
        if done:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

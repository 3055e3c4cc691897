"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Nodes with more links than STAR, and than one in HUBS of all, are hubs; so there are at most 2 * HUBS of them.
STAR, HUBS = 2000, 50_000


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """edges(x, y) + m, the least y of x. A hub's rows, of which there are more than `hub`, stay where they are and meet its least in a broadcast of hubs; those of other nodes are joined by shuffle."""
    least = edges.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("links"))
    is_hub = F.col("links") > hub
    hubs = F.broadcast(least.where(is_hub).drop("links"))
    others = edges.join(hubs.select("x"), "x", "left_anti").join(least.where(~is_hub).drop("links"), "x")
    return edges.join(hubs, "x").unionByName(others)


def _round(edges: DataFrame, hub: int | None) -> DataFrame:
    """One large star, then one small star. Without hubs rows go through the shuffle three times, by x, by x and to be made distinct: a node's rows are few, so its least comes by a window."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = F.min("y").over(Window.partitionBy("x"))
    starred = (both.withColumn("m", least) if hub is None else _with_least(both, hub)).select("x", "y", F.least("x", "m").alias("m"))
    large = starred.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
    if hub is None:
        own = F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))
        return large.repartition("x").distinct().withColumn("m", least).select(F.explode(own).alias("e")).select("e.*").where("x <> y").distinct()
    large = large.distinct()
    low = large.groupBy("x").agg(F.min("y").alias("y"))
    small = _with_least(large, hub).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return small.unionByName(low).distinct()


def _shape(edges: DataFrame) -> tuple[int, int, int]:
    """(links, nodes that are not yet part of one star, most links of a node)."""
    ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.max(F.col("up") + F.col("down"))).first()
    return row[0] or 0, row[1], row[2] or 0


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, root) for every node that has a link to another; root is the smallest node reached.

    Large stars join every larger neighbour to the smallest, small stars every smaller one; after a few rounds, about the
    logarithm of the longest path, each component is one star: every node but the smallest has one link, to the smallest. A
    round's links are written (a job, and one to look at their shape), so lineage stays short.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    n, loose, most = _shape(edges)
    while loose:
        bound = max(STAR, n // HUBS)
        before, edges = edges, written(_round(edges, bound if most > bound else None))
        discard(before)
        n, loose, most = _shape(edges)
    roots = edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(roots)

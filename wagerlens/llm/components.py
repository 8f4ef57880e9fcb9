"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (a, b) hangs on one b, and no b on another: then b is its component's smallest."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)"))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of any orderable type: (node, root), root the smallest node of the component.

    Each round hangs neighbours on smaller ones, first those larger than a node, then those smaller; both
    are an aggregation and a join.  The aggregation is written first: its rows are combined before their
    shuffle, and the join's inputs are plain shuffles, of which Spark splits a node with very many links
    over several tasks.  The number of rounds grows as the logarithm of the longest chain; before each a
    count tells whether any is left to do.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = keep(large)
        lowest = keep(large.groupBy("a").agg(F.min("b").alias("low")))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(lowest.select("a", F.col("low").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        older = edges, large
        edges = keep(small)
        discard(*older)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def joined_by(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of known components, a written table, once further links (a, b) join some of them.

    Only the components that the links touch are nodes of a graph, and where no link is left nothing is done.
    """
    if links.isEmpty():
        return roots
    side = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    known = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = components(known.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = keep(between.select(F.col("node").alias("old"), F.col("root").alias("new")))
    # both are written, so that a component of very many nodes is split in the join of the two
    stayed = roots.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = moved.join(roots.select("node"), F.col("old") == F.col("node"), "left_anti")
    return keep(stayed.unionByName(alone.select(F.col("old").alias("node"), F.col("new").alias("root"))))

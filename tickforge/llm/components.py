"""Connected components over a table of links, by contraction: what a round has joined is one node in the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _tops(up: DataFrame) -> DataFrame:
    """(node, root) with the end of the way that each node's (node, root) begin, by pointer doubling; roots are smaller than their nodes."""
    while True:
        far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialize(up.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "tops")
        moved = new.where("moved").limit(1).count()
        drop_scratch(up)
        up = new.select("node", "root")
        if not moved:
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node reachable.

    Each round hangs every node under its smallest neighbour, if that is smaller, and takes the tops of the trees that
    this makes as the nodes of the next round: links inside a tree go and those that become equal are one, so a link
    is joined again only while it still leads from one tree to another.  Rounds are written to the shared folder.  Joins have
    the tops on one side, once a node, so a node with very many links is only many rows on the other side, which adaptive execution splits.
    """

    def ordered(a, b, found: DataFrame) -> DataFrame:
        return materialize(found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")

    left = ordered(F.col("a"), F.col("b"), links)
    roots = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while left.limit(1).count():
        tops = _tops(materialize(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "smallest-neighbours"))
        new = materialize(roots.join(tops.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        # A greater node of a link always has a top, as the other is smaller.
        rest = left.join(tops.toDF("a", "top_a"), "a", "left").join(tops.toDF("b", "top_b"), "b")
        rest = ordered(F.coalesce("top_a", "a"), F.col("top_b"), rest)
        for old in (tops, roots, left):
            drop_scratch(old)
        roots, left = new, rest
    drop_scratch(left)
    return roots

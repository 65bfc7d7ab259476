"""Connected components of links, as joins over (node, label) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Table


def _to_roots(up: Table) -> DataFrame:
    """Each node's label followed to the end, by taking the label's label until none moves."""
    while True:
        have = up.df
        above = have.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = Table(have.join(above, "label").select("node", F.col("jump").alias("label"), (F.col("jump") < F.col("label")).alias("moved")), "roots")
        up.drop()
        up = moved
        if moved.df.filter("moved").isEmpty():
            return moved.df.select("node", "label")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links(a, b) reach, for every node that has a link.

    Each round every node takes its least neighbour's root, and links are drawn anew between roots, so that of links only
    those remain which join two of them: their number falls by half or more, whatever the graph's shape. Minima are
    combined before they are shuffled, and links meet labels in joins that adaptive execution splits at hot nodes.
    """
    edges = Table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges").df
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        root = _to_roots(Table(least, "least"))
        met = edges.join(root.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(root.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        edges = Table(met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges").df
        above = root.select(F.col("node").alias("label"), F.col("label").alias("root"))
        raised = found.join(above, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        # roots of earlier rounds are in `found` already, and come up again as nodes of this one
        found = Table(raised.unionByName(root.join(found.select("node"), "node", "left_anti")), "found").df
    return found

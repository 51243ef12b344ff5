"""Connected components of a graph of links, on Spark tables alone.

Each round every node points to the least of itself and its neighbours, in an order that is drawn anew each round (so long
chains shrink by a constant share), and the links are contracted to the nodes pointed at. When no link is left, every node's
chain of pointers has been followed to the root of its component. All steps are joins and minima that combine before the
shuffle, so a node with very many neighbours is nobody's single group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def component_roots(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root): one row per node of a link; nodes of one component share a root."""
    links = settle(links.filter("a <> b").select("a", "b").distinct(), "links")
    roots, turn = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(c: str) -> F.Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("id"))

        best = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("low"))
        points = settle(
            best.select("node", F.when(F.col("low") < ranked("node"), F.col("low.id")).otherwise(F.col("node")).alias("to")), "pointers"
        )
        if roots is None:
            roots = points.select("node", F.col("to").alias("root"))
        else:
            step = points.select(F.col("node").alias("root"), "to")
            roots = settle(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = settle(
            links.join(left, "a").join(right, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots

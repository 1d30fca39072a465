"""Connected components of a link table by contraction, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is one node of the component, the same for all of it.

    Each round hooks every node to its smallest neighbour, shortens the paths,
    and replaces the ends of each link by the nodes that they lead to; links inside
    a component vanish. The number of components that still have links at least
    halves in a round, so rounds grow with the logarithm of the longest chain.
    Links that repeat, loops, and a node with a third of all links are fine: every
    step aggregates before it shuffles or is a join whose large keys Spark splits.
    """
    edges = stage(links.where("a <> b").select("a", "b").distinct(), "links")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "hooks")
        while True:  # until every path has length one
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            up = stage(up.join(over, "comp").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("comp")).alias("moved")), "roots")
            moved = not up.where("moved").isEmpty()
            up = up.select("node", "comp")
            if not moved:
                break
        if found is None:
            found = up
        else:
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            found = stage(found.join(over, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
        a, b = (up.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_root")) for c in "ab")
        edges = stage(edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if found is None else found

"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import delete, stage


def _least(edges: DataFrame, at: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(at).alias("u")).agg(F.min(other).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), any number of rows for a pair -> staged (id, component):
    each node of a link between two nodes, with the least node that it reaches.

    Each round hangs every node's larger neighbours, and then its smaller ones,
    on the least node around it; rounds grow as the logarithm of the nodes. The
    least neighbour of a node is a partial aggregate. It is written before it is
    joined to all neighbours: both sides of the join are then dealt out for it
    alone, so that Spark can split the rows of a node that very many hang on.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: v > u hang on the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(_least(both, "a", "b").select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large-star")
        # small star: u and its smaller neighbours, which are few by now, hang on the
        # least of them
        smaller = _least(large, "a", "b")
        hung = large.join(smaller, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(hung.unionByName(smaller.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
        # at rest: stars alone, each leaf on one centre and no centre on anything
        per_node = small.select(F.col("a").alias("x"), F.lit(1).alias("n")).unionByName(small.select(F.col("b").alias("x"), F.lit(0).alias("n")).distinct())
        ends = per_node.groupBy("x").agg(F.sum("n").alias("up"), F.min("n").alias("low"))
        moved = not ends.where("up > 1 OR (up = 1 AND low = 0)").isEmpty()
        for old in (edges, large, least):
            delete(old.sparkSession, old.staged_path)
        edges = small
        if not moved:
            break
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stage(leaves.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), "components")

"""Connected components by repeated contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), both long; root is the same for connected nodes.

    In each round every node points to its neighbour of least rank, if that is less than its own; edges and labels are
    mapped through the pointers. Ranks are hashes, so chains of falling ranks are short and the number of rounds grows
    with the logarithm of the number of nodes.

    Edges with a null end and from a node to itself join nothing and give no node; repeated edges and both directions of one
    count once; columns other than a and b are ignored. No edges give no rows. Rounds are written even for hubs: a node's
    edges are combined before they meet.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(7), c).alias("r"), c.alias("v"))
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least("m", rank(F.col("a")))["v"].alias("to"))
        to = stored(to, "pointers")
        if labels is None:
            labels = to.withColumnRenamed("to", "root")
        else:
            labels = stored(labels.join(to.withColumnRenamed("node", "root"), "root", "left").select(labels["node"], F.coalesce("to", "root").alias("root")), "labels")
        mapped = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = stored(mapped.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

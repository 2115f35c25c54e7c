"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import release, store


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b of bigint): equal labels for connected nodes; label is one of the component's nodes.

    Each round maps every node to the least of itself and its neighbours in an order drawn anew for the round, and contracts the edges;
    nodes that are nobody's least drop out, a constant share in expectation, so rounds grow with the logarithm of the longest path.
    Least neighbours come from aggregates with partial sums, so that a hub's edges are never gathered in one place.
    """
    edges = store(edges.where("a <> b").distinct(), "edges")
    nodes, turn = None, 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), F.least(order("a"), order("b"))["to"].alias("to"))
        both = both.union(edges.select(F.col("b").alias("node"), F.least(order("a"), order("b"))["to"].alias("to")))
        least = store(both.groupBy("node").agg(F.min(order("to"))["to"].alias("to")), "least")
        a, b = least.select(F.col("node").alias("a"), F.col("to").alias("x")), least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        fewer = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        fewer = store(fewer.distinct(), "edges")
        if nodes is None:
            mapped = least.select("node", F.col("to").alias("label"))
        else:
            moved = least.select(F.col("node").alias("label"), "to")
            mapped = nodes.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        mapped = store(mapped, "labels")
        release(edges, least, *([nodes] if nodes is not None else []))
        edges, nodes, turn = fewer, mapped, turn + 1
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

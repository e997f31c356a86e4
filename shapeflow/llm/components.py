"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.llm.common import store


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    A large-star round links each node's larger neighbours to the smallest of its
    neighbourhood, a small-star round the smaller ones; the rounds end when every node hangs
    on its root, after about the square of the logarithm of the node count at most. Each
    round is two partial aggregations and joins on the node, which adaptive execution splits
    where a star's centre is hot; its edges are written to the shared folder, so neither
    lineage nor one executor's loss undoes earlier rounds.
    """
    edges = store(_canonical(edges), "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _canonical(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = store(_canonical(small), "edges")
        # stars: no node is both under a root and a root itself, and each hangs on one root
        state = after.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("nodes")).first()
        edges = after
        if (state["most"] or 1) == 1 and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Intermediate results in the shared folder, and classes of linked nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores behind it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def components(edges: DataFrame) -> DataFrame:
    """Classes of an undirected graph: ``node`` and ``root``, the smallest node of its class.

    ``edges`` has columns ``a`` and ``b``; loops, repeated edges and empty tables are allowed, null
    is not. Large-star and small-star steps by turns replace each edge by one to the smallest known
    neighbour until all that is left are edges to the smallest node. No neighbourhood is collected: a step is a minimum per node,
    combined before the shuffle, and a join of tables that adaptive execution may split at hot nodes.
    Every state is a table in the shared folder.
    """
    state = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        down = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
            .select("col.a", "col.b")
            .where("a <> b")
            .distinct()
        )
        state = materialise(small, "small-star")
        # Done when every node has one edge, to a node without any.
        several = state.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if several.union(state.join(state.select(F.col("b").alias("a")), "a", "left_semi").select("a")).isEmpty():
            break
    roots = state.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

"""Connected components in a number of rounds that grows with the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` except the smallest of its component, b being that smallest.

    Alternates two rewirings until nothing changes: each node hands its larger neighbours to
    its smallest neighbour, then its smaller ones. The edge count never grows beyond the
    start; a node with very many neighbours meets one row of its own in the joins.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a != b").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = (both.filter("b > a").join(least, F.col("a") == F.col("node"))
                 .select(F.col("b").alias("a"), F.least("node", "m").alias("b")).distinct())
        large = cut_lineage(large)
        smallest = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        handed = (large.join(smallest, F.col("a") == F.col("node")).filter("b != m")
                  .select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut_lineage(handed.unionByName(smallest.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct())
    return edges


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node id of each component; nodes without edges are their own."""
    found = stars(edges).select(F.col("a").alias("id"), F.col("b").alias("label"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))

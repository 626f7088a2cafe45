"""Connected components by alternating stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import discard, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One round: each node hands its larger neighbours, then its smaller ones, its least neighbour.

    The least neighbour is a map-side combined aggregate; it is joined back to the edges, a join whose hot
    nodes Spark splits, so the hub of a large group is never gathered.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (
        both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).where("a <> b")
    # every edge now points from the larger to the smaller node
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (least node of the component) for every node that has an edge, but for that least node.

    Nodes are long integers. Edges with a null end and loops are ignored; no edges give an empty result.
    Only the number of edges and a checksum reach the driver. A round's files go when the next round is written.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = materialise(edges.where("a <> b").distinct(), "edges")
    last = None
    while True:
        before, edges = edges, materialise(_stars(edges), "stars")
        discard(before)
        # a changed edge set changes the count or one of the sums
        at = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if at == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = at

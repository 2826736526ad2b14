"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.shared import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node reachable.

    Each round joins every node's larger neighbours, then its smaller ones, to the
    smallest node in its neighbourhood.  All steps are aggregations and joins on
    node keys; a node's neighbours never meet in one row.  The small sides are
    written first, so that both sides of a join come straight from a scan and Spark
    can split the partition of a hub.  Empty edges give no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        e = written(_towards_least(_towards_least(e, "b"), "a").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: every node is either a leaf with one edge, or a centre."""
    ends = e.select(F.col("a").alias("u"), F.lit(1).alias("as_leaf"), F.lit(0).alias("as_centre")).unionByName(e.select(F.col("b").alias("u"), F.lit(0).alias("as_leaf"), F.lit(1).alias("as_centre")))
    by_node = ends.groupBy("u").agg(F.sum("as_leaf").alias("as_leaf"), F.max("as_centre").alias("as_centre"))
    return by_node.filter("as_leaf > 1 or (as_leaf = 1 and as_centre = 1)").isEmpty()


def _towards_least(e: DataFrame, end: str) -> DataFrame:
    """One step on edges (a > b).

    With ``end`` b (large-star) an edge moves on from its smaller end to that node's
    smallest neighbour; with ``end`` a (small-star) a node's smaller neighbours are tied
    to the smallest of them.
    """
    e = written(e, "step") if end == "a" else e
    low = written(e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
    met = e.join(low, F.col(end) == F.col("u"), "left")
    if end == "b":
        return met.select("a", F.coalesce("m", "b").alias("b"))
    moved = met.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
    return moved.select("x.a", "x.b").filter("a <> b")

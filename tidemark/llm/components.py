"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links nodes to the smallest of their neighbourhood: large: their larger neighbours; small: themselves and the smaller ones."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Minimum by partial aggregation: a node with very many neighbours is never gathered.
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node at most, and none where another node links to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that is reachable) of each node of ``edges`` (columns a, b) but the smallest itself.

    Repeated and reversed edges and loops do no harm; null ends are left out; no edges, no rows. Lineage is cut each round.
    A round keeps what is reachable, so that it is done as soon as all that is left are stars; earlier labels, given again as
    edges beside new ones, are stars already.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _only_stars(edges):
        edges = checkpointed(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))

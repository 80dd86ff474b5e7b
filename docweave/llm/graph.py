"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import discard, materialize


def _starred(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or has one edge to such a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) with a != b; root is the least node of its component.

    Alternates large-star and small-star steps until the edges are stars. Each step is a minimum
    per node and a join; it is written out, so a hub is one skewed key against a table with one row
    for each key. Edge counts never grow. Null or looping edges are ignored; no edges, no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "cc-edges")
    while not _starred(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        starred = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        least = starred.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "cc-large")
        root = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-root")
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, materialize(small.union(root.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        discard(old, starred, large, root)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select("b", "b").distinct())


def composed(classes: DataFrame, over: DataFrame) -> DataFrame:
    """(node, root) of two steps: classes, and the components of edges between roots of these or nodes without a class."""
    above = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = classes.join(above.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.union(over.join(classes.select("node").hint("merge"), "node", "left_anti").select("node", "root"))

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.union(least.select("a", F.col("root").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no id has two smaller neighbours, and none that has one is itself the smaller one of an edge. Steps keep what
    is connected, so each id then hangs on the smallest of its component."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    of_id = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_id.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of long ids -> (id, component) for every id in an edge; component is the smallest id reached.

    Alternates large-star and small-star steps, each a grouping and a join, until the edges are stars; they are written to
    the shared folder after each round. Self-loops and nulls are ignored.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        before = edges
        edges = materialize(_small_star(_large_star(edges)), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())

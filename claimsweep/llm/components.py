"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # the edges are joined in both directions; minima are grouped first, so a hub is only ever a join key
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` -> ``(u, v)``: each node but the smallest of its component, and that smallest one.

    Nodes without an edge to another node do not appear. Loops, repeated and reversed edges are allowed;
    null ends are ignored. Each round is written to the shared folder, so lineage stays short.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "component-edges")
    mark = _mark(edges)
    while mark[0]:
        after = stage(_small_star(_large_star(edges).distinct()).distinct(), "component-edges")
        last, mark = mark, _mark(after)
        edges = after
        if mark == last:
            break
    return edges

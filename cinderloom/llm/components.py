"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import drop_table, materialize


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Links every neighbour (larger ones, or those not larger) of a node to the least node of its neighbourhood."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b: long) reaches. Nodes without links are not
    listed. Each round ends in a written table, so lineage stays short."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(_star(sides, larger=True))
        small = materialize(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), larger=False))
        done = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        drop_table(large)
        drop_table(edges)
        edges = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

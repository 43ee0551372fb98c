"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """u and its component's least node, root, for every node that has an edge (u, v) and isn't the least itself.

    Each round's edges are written to the shared folder, so lineage and memory
    stay bounded; the number of rounds grows with the logarithm of the longest path.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        # Large star: every greater neighbour of u is tied to the least of u and its neighbours.
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sym.filter("v > u").join(_least(sym), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its lesser neighbours are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return now.withColumnRenamed("v", "root")

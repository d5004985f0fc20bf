"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): each vertex of an edge and the smallest vertex it is connected with.

    Every round links each vertex's larger neighbours, then its smaller ones, to the smallest of all; the
    rounds needed grow with the logarithm of a component's size. Minima are aggregated before they
    are shuffled, and joins are such that adaptive execution can split hot vertices. Each round is a written
    table. NULLs and loops are passed over.
    """
    held = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = settle(hooked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        held.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

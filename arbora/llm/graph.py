"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v): node and component, the smallest node it reaches, of every node with an edge to another one.

    Edges without a node at one end make none, an edge of a node with itself neither; repeated edges count once; no edges, no
    rows.  Each round is two grouped minima and equi-joins; the number of rounds grows with the logarithm of the longest path."""
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        then = written(small, "edges")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    ends = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _to_min(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the least neighbour of u. The minimum is pre-aggregated; the join back may be split where u is hot."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_min(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    near = _to_min(edges)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node in ``edges(a, b)``: the least id that is reachable. Self loops, repeats and nulls are ignored.

    Rounds needed grow with the logarithm of the number of nodes; each ends in the shared folder.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = print_of(now)
    while True:
        now = stage(_small_star(_large_star(now)), "edges")
        if (new := print_of(now)) == seen:
            break
        seen = new
    heads = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)

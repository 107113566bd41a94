"""Connected components by alternating star contractions, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: one row (node, component) per node in an edge, component being the smallest node reachable.

    Each round joins neighbours to the least neighbour: first larger ones (large
    star), then smaller ones (small star), until every edge points at the least
    node of its component. A round is aggregates and joins by node; a node with
    very many edges is pre-aggregated in the first and split by adaptive execution
    in the second. Self-loops and repeated edges change nothing; an edge with a
    null end is ignored.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = compact(links.distinct())
    seen = _signature(links)
    while seen[0]:
        both = links.union(links.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        links = compact(small.filter("hi <> lo").distinct())
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select("lo", "lo").distinct())


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "hi", "lo"))).first())

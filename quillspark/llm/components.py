"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, limit: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node) for every node that has an edge.

    Each step is a minimum per node, which aggregates before its shuffle, and a join back,
    so a hub with very many edges needs no task that holds them all: the join's skewed
    partitions are split.  Each round is written to the shared folder.  Rounds grow with the logarithm of the longest path; more
    than ``limit`` raise an error.
    """
    x, y = F.col(a), F.col(b)
    edges = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = written(edges, "cc")
    seen = _checksum(edges)
    for _ in range(limit):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        least = written(least, "cc-least")  # read back, the join has two plain shuffles, and adaptive execution can split a hub's edges
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        joined = large.join(small, F.col("u") == F.col("n"))
        edges = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        edges = written(edges.where("u <> v").distinct(), "cc")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {limit} rounds")
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

"""Connected components by large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, written


#: Edges from which the largest stars are split.
FEW = 1_000_000


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 31) - 1))).collect()[0]
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges (u, v); loops and repeats are ignored.

    Links and components stay distributed; the driver sees a count and a
    checksum of each round. Each round is written, so that lineage stays short.
    The centre of a large star is broadcast with its least neighbour.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    while True:
        # large star: each node's larger neighbours go to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("held"))
        large = looked_up(both, least, ["u"], "held", 2 * mark[0], least=FEW).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))
        moved = looked_up(large, least, ["u"], "held", mark[0], least=FEW).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))

"""Transforms of DataFrames that the privacy operators are made of.

Norms, clipping and limits of contributions are single aggregations and windows
over (unit, group) sums; raw rows are never joined back.
"""

from __future__ import annotations

import datetime
import math
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.bounds import Bounds


#: Buckets of random keys: so many counts are broadcast at most.
BUCKETS = 65_536
#: Types of literals in a declared domain.
_KINDS = {bool: "boolean", int: "bigint", float: "double", datetime.date: "date", datetime.datetime: "timestamp_ntz"}


def new_seed() -> int:
    """A seed for one place where noise is drawn; never logged, never used twice."""
    return secrets.randbits(62)


def sums_by_group(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in columns])


def l1_norms(df: DataFrame, unit: str, groups: list[str], columns: list[str]) -> DataFrame:
    """Per unit, the sum over groups of the absolute group sums."""
    return sums_by_group(df, [unit, *groups], columns).groupBy(unit).agg(*[F.sum(F.abs(c)).alias(c) for c in columns])


def l2_norms(df: DataFrame, unit: str, groups: list[str], columns: list[str]) -> DataFrame:
    """Per unit, the root of the sum over groups of the squared group sums."""
    return sums_by_group(df, [unit, *groups], columns).groupBy(unit).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns])


def scale(df: DataFrame, unit: str, factors: DataFrame, columns: list[str]) -> DataFrame:
    """Each column times its unit's factor; factors has the same column names."""
    named = factors.select(unit, *[F.col(c).alias(f"_f_{c}") for c in columns])
    return df.join(named, unit, "left").withColumns({c: F.col(c) * F.col(f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])


def l2_clipped_sums(df: DataFrame, unit: str, groups: list[str], clips: dict[str, float]) -> DataFrame:
    """Sums by group in which no unit's vector of group sums is longer than its clip.

    A unit's factor is 1 / max(1, norm / clip), and 0 for a clip of 0. Null units
    and null values contribute nothing.
    """
    per = df.where(F.col(unit).isNotNull()).groupBy(unit, *groups).agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in clips])
    whole = Window.partitionBy(unit)
    scaled = {}
    for c, clip in clips.items():
        norm = F.sqrt(F.sum(F.col(c) * F.col(c)).over(whole))
        scaled[c] = F.lit(0.0) if clip == 0 else F.col(c) / F.greatest(F.lit(1.0), norm / F.lit(float(clip)))
    clipped = per.select(*groups, *[e.alias(c) for c, e in scaled.items()])
    sums = [F.sum(c).alias(c) for c in clips]
    return clipped.groupBy(*groups).agg(*sums) if groups else clipped.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in clips])


def gaussian(sigma: float, seed: int | None = None) -> Column:
    return F.randn(new_seed() if seed is None else seed) * F.lit(float(sigma))


def add_gaussian_noise(df: DataFrame, sigmas: dict[str, float], draw=gaussian) -> DataFrame:
    return df.withColumns({c: F.col(c) + draw(s) for c, s in sigmas.items()})


def add_clipped_gaussian_noise(df: DataFrame, sigmas: dict[str, tuple[float, Bounds]], draw=gaussian) -> DataFrame:
    """Null as 0, noise, then clamped to the column's range."""
    out = {}
    for c, (sigma, bounds) in sigmas.items():
        e = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + draw(sigma)
        if bounds.parts:
            e = F.least(F.greatest(e, F.lit(float(bounds.low))), F.lit(float(bounds.high)))
        out[c] = e
    return df.withColumns(out)


def filter_columns(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """ranges: column -> (above, below, list); each may be None; above and below are strict."""
    p = F.lit(True)
    for c, (low, high, listed) in ranges.items():
        if low is not None:
            p = p & (F.col(c) > low)
        if high is not None:
            p = p & (F.col(c) < high)
        if listed is not None:
            p = p & F.col(c).isin(*listed)
    return df.filter(p)


def poisson_sampling(df: DataFrame, p: float, seed: int | None = None) -> DataFrame:
    return df.sample(False, p, new_seed() % 2**31 if seed is None else seed)


def sampling_without_replacement(df: DataFrame, rate: float, rows: int, multiplier: float = 2.0, seed: int | None = None) -> DataFrame:
    """rate * rows random rows of an input that reads alike each time; a prefilter keeps about multiplier times as many.

    The rows lie in BUCKETS buckets of their random keys. Buckets below the cut
    are taken whole, only the bucket of the cut is sorted, so that no task holds
    the sample.
    """
    seed = new_seed() if seed is None else seed
    wanted = int(rate * rows)
    drawn = df.filter(F.rand(seed) < min(1.0, multiplier * rate)).withColumn("_order", F.rand(seed + 1)).withColumn("_bucket", F.floor(F.col("_order") * BUCKETS))
    counts = drawn.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most BUCKETS rows
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    cut = counts.withColumn("_before", before).where(F.col("_before") < wanted)
    kept = drawn.join(F.broadcast(cut), "_bucket")
    whole = kept.where(F.col("_before") + F.col("_n") <= wanted)
    edge = kept.where(F.col("_before") + F.col("_n") > wanted).withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order"))).where(F.col("_rank") <= wanted - F.col("_before"))
    return whole.select(*df.columns).unionAll(edge.select(*df.columns))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def limit_contributions(df: DataFrame, unit: str, k: int, order: Column | None = None) -> DataFrame:
    """At most k random rows of each unit; order replaces the random one in tests."""
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(F.rand(new_seed()) if order is None else order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def distinct_aggregates(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """name -> (count, sum, mean, std or var; column), each over the column's different values in a group."""
    how = {"count": F.count, "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}
    out = None
    for c in dict.fromkeys(c for _, c in aggs.values()):
        part = df.select(*keys, c).distinct().groupBy(*keys).agg(*[how[f](c).alias(n) for n, (f, x) in aggs.items() if x == c])
        out = part if out is None else out.join(part, keys) if keys else out.crossJoin(part)
    return out.select(*keys, *aggs)


def public_values(spark: SparkSession, domains: dict[str, Bounds], most: int = 10_000_000) -> DataFrame:
    """Every combination of the columns' declared finite domains, made by Spark; over `most` of them it raises."""
    found = math.prod(len(b.values()) for b in domains.values())
    if found > most:
        raise ValueError(f"{found} combinations of public values, at most {most}")
    out = None
    for c, b in domains.items():
        one = spark.createDataFrame([(v,) for v in b.values()], f"`{c}` {_KINDS.get(type(b.values()[0]), 'string')}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    if shared := set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    return left.crossJoin(right)


def natural_inner_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)

"""Results for the whole from samples of the tables.

Rows carry a weight, relations a factor: what a sampled row stands for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transforms as t
from ..plans.expr import quoted, to_column
from ..plans.nodes import Join, Map, Reduce, Relation, Table

ROW_WEIGHT = "_ROW_WEIGHT_"


@dataclass
class Weighted:
    df: DataFrame
    factor: float


def adjusted(r: Relation, spark: SparkSession, weights: float | dict[str, float]) -> Weighted:
    """r over sampled tables, its aggregates scaled to the whole.

    weights: one for all tables, or by name (1 where none is given). Counts and
    sums grow by the factor; a mean stays; lost groups are allowed for by the
    share of groups seen once. Set operations and values have no weights.
    """
    if isinstance(r, Table):
        w = weights.get(r.name, 1.0) if isinstance(weights, dict) else weights
        return Weighted(r.dataframe(spark).withColumn(ROW_WEIGHT, F.lit(1.0)), float(w))
    if isinstance(r, Map):
        x = adjusted(r.input, spark, weights)
        df = x.df
        if r.where is not None:
            df = df.filter(to_column(r.where))
        if r.order:
            df = df.orderBy(*[to_column(e).asc_nulls_last() if up else to_column(e).desc_nulls_first() for e, up in r.order])
        if r.skip is not None:
            df = df.offset(r.skip)
        if r.max_rows is not None:
            df = df.limit(r.max_rows)
        return Weighted(df.select(*[to_column(e).alias(n) for n, e in r.exprs], ROW_WEIGHT), x.factor)
    if isinstance(r, Join):
        a, b = adjusted(r.left, spark, weights), adjusted(r.right, spark, weights)
        left, right = a.df.toDF(*r.left_names, "_wl"), b.df.toDF(*r.right_names, "_wr")
        joined = left.crossJoin(right) if r.on is None else left.join(right, to_column(r.on), r.how)
        weight = F.coalesce("_wl", F.lit(1.0)) * F.coalesce("_wr", F.lit(1.0))
        return Weighted(joined.withColumn(ROW_WEIGHT, weight).select(*map(quoted, r.names), ROW_WEIGHT), a.factor * b.factor)
    if isinstance(r, Reduce):
        return _reduce(r, adjusted(r.input, spark, weights))
    raise ValueError(f"{type(r).__name__} has no weights")


def _reduce(r: Reduce, x: Weighted) -> Weighted:
    bad = [a.name for _, a in r.aggs if a.name not in ("count", "sum", "mean", "first", "last") or a.distinct]
    if bad:
        raise ValueError(f"aggregates without weights: {bad}")
    made = [to_column(a).alias(n) for n, a in r.aggs] + [F.sum(ROW_WEIGHT).alias("_w")]
    groups = x.df.groupBy(*r.keys).agg(*made) if r.keys else x.df.agg(*made)
    once, more = F.count_if(F.col("_w") <= 1), F.count_if(F.col("_w") > 1)
    share = F.when(once + more > 0, (F.lit(x.factor**0.5) * once + more) / (once + more)).otherwise(1.0)
    lost = groups.agg(share.alias("_c")) if r.keys else groups.sparkSession.createDataFrame([(1.0,)], "_c double")
    both = groups.crossJoin(lost)  # one row
    scaled = {"count": lambda c: c * F.col("_c") * x.factor, "sum": lambda c: c * x.factor, "mean": lambda c: c / F.col("_c"), "first": lambda c: c, "last": lambda c: c}
    out = both.select(*r.keys, *[scaled[a.name](F.col(n)).alias(n) for n, a in r.aggs], F.lit(1.0).alias(ROW_WEIGHT))
    return Weighted(out, 1.0)


def sampled(r: Relation, sample) -> Relation:
    """r with each table's rows drawn by sample(DataFrame, table)."""
    if isinstance(r, Table):
        return Table(r.fields, r.size, r.name, lambda spark: sample(r.dataframe(spark), r))
    if isinstance(r, (Map, Reduce, Join)):
        return r.rebuild([sampled(i, sample) for i in r.inputs])
    raise ValueError(f"{type(r).__name__} cannot be sampled")


def poisson(r: Relation, p: float | dict[str, float], seed: int | None = None) -> Relation:
    return sampled(r, lambda df, x: t.poisson_sampling(df, p.get(x.name, 1.0) if isinstance(p, dict) else p, seed))


def without_replacement(r: Relation, rate: float, seed: int | None = None) -> Relation:
    return sampled(r, lambda df, x: t.sampling_without_replacement(df, rate, x.size[1], seed=seed))

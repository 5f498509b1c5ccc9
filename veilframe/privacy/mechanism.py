"""Differentially private aggregation of a tracked relation."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transforms as t
from ..plans.bounds import UNKNOWN, Bounds
from ..plans.expr import Col, bounds_of, quoted
from ..plans.nodes import Field, Reduce, Relation
from .ledger import Event, Gaussian, NoOp, Parameters, noise_multiplier, tau
from .unit import UNIT, WEIGHT

#: Aggregates that can be released; the last few only of a group key.
RELEASED = {"mean", "count", "sum", "std", "var"}
OF_KEYS = {"min", "max", "median", "first", "last", "quantile", "quantiles"}
_INNER = "_vf_"


def releasable(r: Reduce) -> bool:
    return all(a.name in RELEASED or a.name in OF_KEYS and isinstance(a.args[0], Col) and a.args[0].name in r.keys for _, a in r.aggs)


@dataclass(frozen=True)
class DpReduce(Relation):
    """A Reduce whose groups and aggregates are released with noise.

    tracked is the Reduce's input with UNIT and WEIGHT. The budget's tau_share
    goes to group keys if any of them is not declared public; the rest is split
    evenly over the different sums that the aggregates need. Compile once: each
    DataFrame draws its noise anew when run, see released().
    """

    tracked: Relation = None
    reduce: Reduce = None
    parameters: Parameters = None
    draw: object = None  # replaces the noise in tests

    @property
    def inputs(self):
        return (self.tracked,)

    @classmethod
    def build(cls, tracked: Relation, reduce: Reduce, parameters: Parameters, draw=None) -> DpReduce:
        if not releasable(reduce):
            raise ValueError(f"aggregates that cannot be released: {[a.name for _, a in reduce.aggs]}")
        made = [Field(f.name, f.type, f.bounds, f.unique) for f in reduce.fields]
        out = cls(tuple(made), reduce.size, tracked, reduce, parameters, draw)
        out.plan()  # raises if a sum has no bound
        return out

    def rebuild(self, inputs):
        return DpReduce.build(inputs[0], self.reduce, self.parameters, self.draw)

    @property
    def public_keys(self):
        return [k for k in self.reduce.keys if self.tracked[k].bounds.finite and not self.tracked[k].bounds.nullable]

    @property
    def private_keys(self):
        return [k for k in self.reduce.keys if k not in self.public_keys]

    def budget(self) -> tuple[float, float]:
        p = self.parameters
        share = 1 - p.tau_share if self.private_keys else 1.0
        return p.epsilon * share, p.delta * share

    def plan(self) -> dict[tuple, dict[str, float]]:
        """For each set of rows (all, or the distinct values of a column), the sums and their clips."""
        p, multiplicity = self.parameters, float(self._multiplicity())
        parts: dict = {}
        ranges, clips = self.tracked.bounds(), dict(p.clips)
        for _, a in self.reduce.aggs:
            if a.name in OF_KEYS:
                continue
            c = a.args[0].name if isinstance(a.args[0], Col) else None
            rows = parts.setdefault(c if a.distinct else None, {})
            rows[(c, "n")] = multiplicity
            if a.name == "count":
                continue
            bound = clips.get(c, bounds_of(a.args[0], ranges).absolute())
            if bound is None:
                raise ValueError(f"{c} has no declared range; give a clipping value")
            rows[(c, "s")] = bound * multiplicity
            if a.name in ("std", "var"):
                rows[(c, "q")] = bound * bound * multiplicity
            if a.name == "sum":
                rows.pop((c, "n")) if not any(b.name != "sum" and b.distinct == a.distinct and b.args == a.args for _, b in self.reduce.aggs) else None
        return parts

    def event(self) -> Event:
        """What the release costs; the multipliers are those of the noise that is drawn."""
        out: Event = NoOp()
        p = self.parameters
        if self.private_keys:
            out = out.compose(Gaussian(noise_multiplier(p.epsilon * p.tau_share, p.delta * p.tau_share)))
        n = sum(map(len, self.plan().values()))
        for _ in range(n):
            e, d = self.budget()
            out = out.compose(Gaussian(noise_multiplier(e / n, d / n)))
        return out

    def keys(self, spark, df: DataFrame) -> DataFrame | None:
        """Group keys that may be seen: all of the public ones' domain, the private ones with enough units."""
        p, draw = self.parameters, self.draw or t.gaussian
        public = t.public_values(spark, {k: self.tracked[k].bounds for k in self.public_keys}) if self.public_keys else None
        if not self.private_keys:
            return public
        own = df.where(F.col(UNIT).isNotNull()).select(UNIT, *self.private_keys).distinct()
        own = t.limit_contributions(own, UNIT, p.max_groups)
        counts = own.groupBy(*self.private_keys).agg(F.count("*").alias(_INNER + "units"))
        e, d = p.epsilon * p.tau_share, p.delta * p.tau_share
        noisy = t.add_gaussian_noise(counts, {_INNER + "units": noise_multiplier(e, d) * math.sqrt(p.max_groups)}, draw)
        private = noisy.where(F.col(_INNER + "units") > tau(e, d, p.max_groups)).select(*self.private_keys)
        return private if public is None else public.crossJoin(private)

    def compile(self, spark, inputs):
        df, keys = inputs[0], list(self.reduce.keys)
        draw = self.draw or t.gaussian
        n = sum(map(len, self.plan().values()))
        shown = self.keys(spark, df)
        out = shown
        for part, sums in self.plan().items():
            rows = df.select(UNIT, *[quoted(c) for c in dict.fromkeys([*keys, *(c for c, _ in sums if c is not None)])])
            cols, clips = {}, {}
            for (c, kind), clip in sums.items():
                name = self._name(part, c, kind)
                x = F.lit(1.0) if c is None else F.col(quoted(c)).cast("double") if kind != "n" else F.when(F.col(quoted(c)).isNull(), 0.0).otherwise(1.0)
                cols[name] = x * x if kind == "q" else x
                clips[name] = clip
            if part is None:
                own = t.l2_clipped_sums(rows.select(UNIT, *[quoted(k) for k in keys], *[e.alias(k) for k, e in cols.items()]), UNIT, keys, clips)
            else:
                own = self._of_distinct(rows, part, cols, clips)
            if out is None:
                out = own
            elif keys:
                on = None
                own = own.withColumnsRenamed({k: _INNER + "k_" + k for k in keys})
                for k in keys:
                    same = F.col(k).eqNullSafe(F.col(_INNER + "k_" + k))
                    on = same if on is None else on & same
                out = out.join(own, on, "left").drop(*[_INNER + "k_" + k for k in keys])
            else:
                out = out.crossJoin(own)
        e, d = self.budget()
        size = self.tracked.size[1]
        noise = {}
        for part, sums in self.plan().items():
            for (c, kind), clip in sums.items():
                top = size if math.isfinite(size) else None
                b = UNKNOWN
                if top is not None:
                    bound = 1.0 if kind == "n" else clip / self._multiplicity()
                    b = Bounds.of((-bound * top if kind == "s" else 0.0, bound * top))
                elif kind != "s":
                    b = Bounds.of((0.0, 1.7e308))
                noise[self._name(part, c, kind)] = (noise_multiplier(e / n, d / n) * clip, b)
        if noise:
            out = t.add_clipped_gaussian_noise(out, noise, draw)
        made = [F.col(k) for k in keys]
        for name, a in self.reduce.aggs:
            c = a.args[0].name if isinstance(a.args[0], Col) else None
            part = c if a.distinct else None
            if a.name in OF_KEYS:
                made.append(F.col(c).alias(name))
                continue
            number = F.col(self._name(part, c, "n")) if a.name != "sum" else None
            if a.name == "count":
                made.append(F.round(number).cast("bigint").alias(name))
                continue
            s = F.col(self._name(part, c, "s"))
            mean = s / F.greatest(F.lit(1.0), number) if number is not None else None
            if a.name == "sum":
                made.append(s.alias(name))
            elif a.name == "mean":
                made.append(mean.alias(name))
            else:
                var = F.greatest(F.lit(0.0), F.col(self._name(part, c, "q")) / F.greatest(F.lit(1.0), number) - mean * mean)
                made.append((F.sqrt(var) if a.name == "std" else var).alias(name))
        return out.select(*made)

    def _multiplicity(self) -> int:
        return max(1, math.floor(self.parameters.multiplicity(self.tracked.size[1], self.tracked[UNIT].unique)))

    def _of_distinct(self, rows: DataFrame, part: str, cols: dict, clips: dict) -> DataFrame:
        """Sums over the different values of a column in each group.

        Every unit brings as many values as its multiplicity allows, chosen from
        its own rows alone, before values are made different: without a unit, at
        most these values go, each of which is clipped.
        """
        keys, many = [quoted(k) for k in self.reduce.keys], self._multiplicity()
        value = [*keys, *([quoted(part)] if part not in self.reduce.keys else [])]
        rows = rows.where(F.col(UNIT).isNotNull() & F.col(quoted(part)).isNotNull()).select(UNIT, *value).distinct()
        own = t.limit_contributions(rows, UNIT, many, F.xxhash64(*value))
        sums = [F.sum(F.greatest(F.lit(-clips[k] / many), F.least(F.lit(clips[k] / many), e))).alias(k) for k, e in cols.items()]
        return own.select(*value).distinct().groupBy(*keys).agg(*sums)

    @staticmethod
    def _name(part, c, kind):
        plain = "" if c is None else hashlib.md5(c.encode()).hexdigest()[:12]
        return f"{_INNER}{kind}_{'all' if part is None else 'distinct'}_{plain}"


def released(df: DataFrame, path: str) -> DataFrame:
    """Write a noised result once and hand out what was written.

    A DataFrame with noise draws again each time it runs; several draws could be
    averaged. path must lie in storage that the cluster shares.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["DpReduce", "WEIGHT", "releasable", "released", "replace"]

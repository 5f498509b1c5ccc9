"""Expressions: columns, literals, functions and aggregates, with ranges and Spark columns."""

from __future__ import annotations

import datetime
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import REGISTRY, java_pattern
from .bounds import UNKNOWN, Bounds


class Expr:
    """Compares by structure; == and friends are methods, as in Spark: use eq(), gt() ... or operators below."""

    def columns(self) -> set[str]:
        return set().union(*(a.columns() for a in getattr(self, "args", ())))

    def aggregates(self) -> list[Agg]:
        if isinstance(self, Agg):
            return [self]
        return [x for a in getattr(self, "args", ()) for x in a.aggregates()]

    def replace(self, mapping: dict) -> Expr:
        """Sub-expressions that are keys of mapping by their values."""
        if self in mapping:
            return mapping[self]
        if isinstance(self, Fn):
            return Fn(self.name, tuple(a.replace(mapping) for a in self.args))
        if isinstance(self, Agg):
            return Agg(self.name, tuple(a.replace(mapping) for a in self.args), self.distinct, self.param)
        return self

    def dot(self, fields: dict[str, Bounds] | None = None) -> str:
        """Graphviz text of the expression, with the range of each part over rows of such columns."""
        nodes: list[str] = []
        edges: list[str] = []

        def walk(e) -> int:
            own = len(nodes)
            name = e.name if isinstance(e, (Col, Fn, Agg)) else repr(e.value)
            text = f"{name}{' distinct' * getattr(e, 'distinct', False)}\\n{bounds_of(e, fields or {}).text()}"
            nodes.append(f'  e{own} [label="{text.replace(chr(34), chr(39))}"];')
            for a in getattr(e, "args", ()):
                edges.append(f"  e{walk(a)} -> e{own};")
            return own

        walk(self)
        return "digraph {\n" + "\n".join(nodes + edges) + "\n}"

    def label(self) -> str:
        """A name for an unnamed expression, from its content."""
        return self.name if isinstance(self, Col) else "field_" + hashlib.md5(repr(self).encode()).hexdigest()[:8]

    def __add__(self, o): return Fn("plus", (self, lit(o)))
    def __sub__(self, o): return Fn("minus", (self, lit(o)))
    def __mul__(self, o): return Fn("multiply", (self, lit(o)))
    def __truediv__(self, o): return Fn("divide", (self, lit(o)))
    def __gt__(self, o): return Fn("gt", (self, lit(o)))
    def __lt__(self, o): return Fn("lt", (self, lit(o)))
    def __ge__(self, o): return Fn("gt_eq", (self, lit(o)))
    def __le__(self, o): return Fn("lt_eq", (self, lit(o)))
    def __and__(self, o): return Fn("and", (self, lit(o)))
    def __or__(self, o): return Fn("or", (self, lit(o)))
    def __invert__(self): return Fn("not", (self,))
    def eq(self, o): return Fn("eq", (self, lit(o)))
    def isin(self, *v): return Fn("in_list", (self, *map(lit, v)))


@dataclass(frozen=True)
class Col(Expr):
    name: str

    def columns(self):
        return {self.name}


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Fn(Expr):
    name: str
    args: tuple

    def __post_init__(self):
        spec = REGISTRY.get(self.name)
        if spec is None:
            raise ValueError(f"no function {self.name}")
        if not spec.low <= len(self.args) <= spec.high:
            raise ValueError(f"{self.name} takes {spec.low} to {spec.high} arguments")


#: Aggregates, and those of them that have a distinct form.
AGGREGATES = {"min", "max", "median", "n_unique", "first", "last", "mean", "list", "count", "quantile", "quantiles", "sum", "std", "var"}
DISTINCT = {"mean", "count", "sum", "std", "var"}


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    args: tuple
    distinct: bool = False
    param: object = None

    def __post_init__(self):
        if self.name not in AGGREGATES or self.distinct and self.name not in DISTINCT:
            raise ValueError(f"no aggregate {self.name}{' distinct' * self.distinct}")


def col(name: str) -> Col:
    return Col(name)


def lit(value) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def fn(name: str, *args) -> Fn:
    return Fn(name, tuple(map(lit, args)))


def agg(name: str, arg="*", distinct=False, param=None) -> Agg:
    return Agg(name, (Lit(1) if arg == "*" else col(arg) if isinstance(arg, str) else arg,), distinct, param)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_column(e: Expr) -> Column:
    if isinstance(e, Col):
        return F.col(quoted(e.name))
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Agg):
        return _aggregate(e)
    if e.name == "datetime_diff":
        unit = e.args[2].value if isinstance(e.args[2], Lit) else e.args[2].name
        return F.timestamp_diff(str(unit).upper(), to_column(e.args[1]), to_column(e.args[0]))
    if e.name == "date_format":
        return F.date_format(to_column(e.args[0]), java_pattern(e.args[1].value))
    if e.name == "from_unixtime":
        return F.from_unixtime(to_column(e.args[0]), java_pattern(e.args[1].value) if len(e.args) > 1 else "yyyy-MM-dd HH:mm:ss")
    if e.name == "in_list":
        return to_column(e.args[0]).isin(*[a.value if isinstance(a, Lit) else to_column(a) for a in e.args[1:]])
    return REGISTRY[e.name].column(*map(to_column, e.args))


def _aggregate(e: Agg) -> Column:
    c = to_column(e.args[0])
    if e.distinct:
        if e.name == "count":
            return F.count_distinct(c)
        if e.name == "sum":
            return F.sum_distinct(c)
        return _distinct(e.name, e.args[0])
    simple = {"min": F.min, "max": F.max, "median": F.median, "n_unique": F.count_distinct, "first": F.first, "last": F.last, "mean": F.avg, "list": F.collect_list, "count": F.count, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp}
    if e.name in simple:
        return simple[e.name](c)
    return F.percentile(c, F.lit(e.param) if e.name == "quantile" else F.array(*map(F.lit, e.param)))


def _distinct(name: str, arg: Expr) -> Column:
    if not isinstance(arg, Col):
        raise ValueError("a distinct aggregate takes a column here")
    return F.expr(f"{ {'mean': 'avg', 'std': 'stddev_samp', 'var': 'var_samp'}[name]}(DISTINCT {quoted(arg.name)})")


def type_of(e: Expr, types: dict[str, str]) -> str:
    if isinstance(e, Col):
        return types[e.name]
    if isinstance(e, Lit):
        v = e.value
        return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "datetime" if isinstance(v, datetime.datetime) else "date" if isinstance(v, datetime.date) else "text"
    if isinstance(e, Agg):
        if e.name in ("count", "n_unique"):
            return "integer"
        return "float" if e.name in ("mean", "std", "var", "median", "quantile") else type_of(e.args[0], types)
    t = REGISTRY[e.name].type
    return t if isinstance(t, str) else t([type_of(a, types) for a in e.args])


def bounds_of(e: Expr, fields: dict[str, Bounds], size: tuple[float, float] = (0, float("inf"))) -> Bounds:
    """The range of e over rows whose columns have the given ranges; size bounds a group's rows."""
    if isinstance(e, Col):
        return fields.get(e.name, UNKNOWN)
    if isinstance(e, Lit):
        return Bounds.of(nullable=True) if e.value is None else Bounds.of(e.value)
    args = [bounds_of(a, fields, size) for a in e.args]
    if isinstance(e, Fn):
        return REGISTRY[e.name].image(args)
    x = args[0]
    if e.name in ("count", "n_unique"):
        return Bounds.of((0 if x.nullable or e.distinct else size[0], size[1]))
    if e.name in ("min", "max", "first", "last"):
        return x
    if e.name in ("mean", "median", "quantile"):
        return x.hull().null(x.nullable)
    a = x.absolute()
    if a is None:
        return UNKNOWN
    if e.name == "sum":
        low, high = min(0, x.low) if x.nullable or size[0] != size[1] else x.low, max(0, x.high) if x.nullable or size[0] != size[1] else x.high
        ends = [low * size[1] if low < 0 else low * size[0], high * size[1] if high > 0 else high * size[0]]
        return Bounds.of((min(ends), max(ends)), nullable=x.nullable)
    span = float(x.high - x.low)
    if e.name == "std":  # of two rows: the sample statistic passes half the span
        return Bounds.of((0.0, span / 2**0.5), nullable=True)
    if e.name == "var":
        return Bounds.of((0.0, span * span / 2), nullable=True)
    return UNKNOWN


def narrow(fields: dict[str, Bounds], p: Expr) -> dict[str, Bounds]:
    """Ranges of the rows that satisfy p."""
    if isinstance(p, Lit) and p.value is False:
        return {k: Bounds((), False) for k in fields}
    if not isinstance(p, Fn):
        return fields
    if p.name == "and":
        return narrow(narrow(fields, p.args[0]), p.args[1])
    if p.name == "or":
        a, b = narrow(fields, p.args[0]), narrow(fields, p.args[1])
        return {k: a[k].union(b[k]) if fields[k].known or a[k].known and b[k].known else fields[k] for k in fields}
    out = dict(fields)

    def cut(e, other):
        if isinstance(e, Col) and e.name in out:
            out[e.name] = out[e.name].intersect(other.null(False))

    if p.name in ("gt", "gt_eq", "lt", "lt_eq", "eq"):
        a, b = p.args
        x, y = bounds_of(a, fields), bounds_of(b, fields)
        up = p.name in ("gt", "gt_eq")
        try:
            for e, o, above in ((a, y, up), (b, x, not up)):
                if p.name == "eq":
                    cut(e, o)
                elif o.parts and isinstance(e, Col):
                    own = fields.get(e.name, UNKNOWN)
                    edge = o.low if above else o.high
                    if own.parts:
                        cut(e, Bounds.of((edge, max(own.high, edge)) if above else (min(own.low, edge), edge)))
                    elif isinstance(edge, (int, float)) and not isinstance(edge, bool):
                        cut(e, Bounds.of((edge, float("inf")) if above else (-float("inf"), edge)))
        except TypeError:
            return fields
    elif p.name == "in_list" and all(isinstance(a, Lit) for a in p.args[1:]):
        cut(p.args[0], Bounds.of(*[a.value for a in p.args[1:]]))
    elif p.name == "not" and isinstance(p.args[0], Fn) and p.args[0].name == "is_null":
        if isinstance(e := p.args[0].args[0], Col):
            out[e.name] = out[e.name].null(False)
    return out

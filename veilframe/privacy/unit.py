"""Privacy units: who each row belongs to, carried through every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.bounds import Bounds
from ..plans.expr import Col, Lit, col, fn
from ..plans.nodes import Field, Join, Map, Reduce, Relation, SetOp, Table, Values, set_op, table

UNIT, WEIGHT = "_PRIVACY_UNIT_", "_PRIVACY_UNIT_WEIGHT_"
#: As the unit column: each row is a unit of its own.
ROW = "_PRIVACY_UNIT_ROW_"


@dataclass(frozen=True)
class Step:
    """From a column of this table to a column of the table it refers to."""

    referring: str
    table: str
    referred: str


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    column: str
    weight: str | None = None


@dataclass(frozen=True)
class PrivacyUnit:
    """table -> Path; tables that are not named are public."""

    paths: dict[str, Path] = field(default_factory=dict)
    hashed: bool = True

    @classmethod
    def of(cls, paths: dict, hashed: bool = True) -> PrivacyUnit:
        """table -> (list of (referring, table, referred), column[, weight])."""
        return cls({t: Path(tuple(Step(*s) for s in p[0]), *p[1:]) for t, p in paths.items()}, hashed)


class Unreachable(ValueError):
    """The relation cannot be given the property that was asked for."""


class Tracker:
    """Rewrites relations so that UNIT and WEIGHT stand first among their columns.

    hard: also where that changes what a row means: groups become groups within
    a unit, joins of two tracked sides join within a unit.
    """

    def __init__(self, unit: PrivacyUnit, tables: dict[str, Relation], hard: bool = True):
        self.unit, self.tables, self.hard = unit, tables, hard

    def tracked(self, r: Relation) -> bool:
        return isinstance(r, Table) and r.name in self.unit.paths or any(self.tracked(i) for i in r.inputs)

    def table(self, r: Table) -> Relation:
        path = self.unit.paths[r.name]
        if path.column == ROW:
            unit, joined = fn("newid"), r
        else:
            joined, at = r, None
            for i, step in enumerate(path.steps):
                other = self.tables[step.table]
                wanted = path.steps[i + 1].referring if i + 1 < len(path.steps) else path.column
                key, value = f"_key{i}", f"_ref{i}"
                small = Map.build(other, {key: col(step.referred), value: col(wanted), **({"_weight": col(path.weight)} if path.weight and i + 1 == len(path.steps) else {})})
                left = at or step.referring
                joined = Join.build(joined, small, "inner", fn("eq", col(left), col(key)), joined.names, small.names)
                at = value
            unit = col(at or path.column)
            if self.unit.hashed:
                unit = fn("md5", unit)
        if path.weight:
            weight = col("_weight" if path.steps else path.weight)
        else:
            weight = Lit(1)
        return Map.build(joined, {UNIT: unit, WEIGHT: weight, **{n: col(n) for n in r.names}})

    def track(self, r: Relation) -> Relation:
        if isinstance(r, Table):
            if r.name not in self.unit.paths:
                raise Unreachable(f"{r.name} is public")
            return self.table(r)
        if isinstance(r, Map):
            return self.map(r, self.track(r.input))
        if isinstance(r, Reduce):
            return self.reduce(r, self.track(r.input))
        if isinstance(r, Join):
            both = self.tracked(r.left), self.tracked(r.right)
            return self.join(r, self.track(r.left) if both[0] else r.left, self.track(r.right) if both[1] else r.right, both)
        if isinstance(r, SetOp):
            return set_op(r.op, self.track(r.left), self.track(r.right), r.all, r.by_name)
        if isinstance(r, Values):
            raise Unreachable("values have no unit")
        raise Unreachable(type(r).__name__)

    def map(self, r: Map, inner: Relation) -> Relation:
        if r.max_rows is not None or r.skip is not None:
            raise Unreachable("a limit mixes units")
        return Map.build(inner, {UNIT: col(UNIT), WEIGHT: col(WEIGHT), **dict(r.exprs)}, r.where, r.order)

    def reduce(self, r: Reduce, inner: Relation) -> Relation:
        if not self.hard:
            raise Unreachable("a group would change its meaning")
        made = Reduce.build(inner, {UNIT: col(UNIT), **{k: col(k) for k in r.keys}}, {WEIGHT: fn_sum(WEIGHT), **dict(r.aggs)})
        return Map.build(made, {n: col(n) for n in [UNIT, WEIGHT, *r.names]})

    def join(self, r: Join, left: Relation, right: Relation, tracked: tuple[bool, bool]) -> Relation:
        """left and right are tracked as told; at least one is."""
        if all(tracked) and not self.hard:
            raise Unreachable("a join within units would change its meaning")
        names = [["_l" + UNIT, "_l" + WEIGHT, *r.left_names] if tracked[0] else list(r.left_names), ["_r" + UNIT, "_r" + WEIGHT, *r.right_names] if tracked[1] else list(r.right_names)]
        on = r.on
        how = r.how
        if all(tracked):
            same = fn("eq", col("_l" + UNIT), col("_r" + UNIT))
            on, how = same if on is None else on & same, "inner" if how == "cross" else how
        made = Join.build(left, right, how, on, *names)
        sides = [s for s, t in zip("lr", tracked, strict=True) if t]
        units = [col(f"_{s}{UNIT}") for s in sides]
        weights = [col(f"_{s}{WEIGHT}") for s in sides]
        unit = units[0] if len(units) == 1 else fn("coalesce", *units)
        weight = weights[0] if len(weights) == 1 else fn("multiply", *[fn("coalesce", w, 1) for w in weights])
        out = Map.build(made, {UNIT: unit, WEIGHT: weight, **{n: col(n) for n in r.names}})
        # an outer join may give rows of no unit; they belong to no one and go
        return Map.build(out, {n: col(n) for n in out.names}, ~fn("is_null", col(UNIT))) if how in ("left", "right", "full") else out


def fn_sum(name: str):
    from ..plans.expr import Agg

    return Agg("sum", (col(name),))


def check_tracked(r: Relation) -> None:
    if r.names[:2] != [UNIT, WEIGHT]:
        raise Unreachable("the relation carries no unit")


__all__ = ["ROW", "UNIT", "WEIGHT", "Bounds", "Col", "Field", "Path", "PrivacyUnit", "Step", "Tracker", "Unreachable", "table"]

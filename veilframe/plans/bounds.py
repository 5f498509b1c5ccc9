"""Value ranges: sets of closed intervals over any ordered values, held at plan time.

A range over-approximates the values that a column can hold. A finite set of
values is a set of points. Ranges never come from the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from itertools import product

#: Above this many intervals a range becomes its hull.
CAPACITY = 128
INF = math.inf


@dataclass(frozen=True)
class Bounds:
    """parts: sorted disjoint (low, high); None if nothing is known."""

    parts: tuple | None = None
    nullable: bool = True

    @classmethod
    def of(cls, *parts, nullable: bool = False) -> Bounds:
        """Intervals (low, high) or single values."""
        return cls(_merged([p if isinstance(p, tuple) else (p, p) for p in parts]), nullable)

    @property
    def known(self) -> bool:
        return self.parts is not None

    @property
    def empty(self) -> bool:
        return self.parts == ()

    @property
    def finite(self) -> bool:
        return self.known and all(a == b for a, b in self.parts)

    def values(self) -> list:
        if not self.finite:
            raise ValueError("the range is no finite set")
        return [a for a, _ in self.parts]

    @property
    def low(self):
        return self.parts[0][0] if self.parts else None

    @property
    def high(self):
        return self.parts[-1][1] if self.parts else None

    def text(self, most: int = 4) -> str:
        """The range in words, its first parts only."""
        if self.parts is None:
            return "any" + " or null" * self.nullable
        shown = " ".join(f"{{{a}}}" if a == b else f"[{a}, {b}]" for a, b in self.parts[:most])
        return (shown or "none") + " ..." * (len(self.parts) > most) + " or null" * self.nullable

    def hull(self) -> Bounds:
        return self if not self.parts else replace(self, parts=((self.low, self.high),))

    def contains(self, value) -> bool:
        if value is None:
            return self.nullable
        return not self.known or any(a <= value <= b for a, b in self.parts)

    def subset(self, other: Bounds) -> bool:
        if self.nullable and not other.nullable or other.known and not self.known:
            return False
        return not other.known or all(any(c <= a and b <= d for c, d in other.parts) for a, b in self.parts)

    def union(self, other: Bounds) -> Bounds:
        if not (self.known and other.known) or not _comparable(self, other):
            return Bounds(None, self.nullable or other.nullable)
        return Bounds(_merged([*self.parts, *other.parts]), self.nullable or other.nullable)

    def intersect(self, other: Bounds) -> Bounds:
        nullable = self.nullable and other.nullable
        if not (self.known and other.known):
            return Bounds(self.parts if self.known else other.parts, nullable)
        if not _comparable(self, other):
            return replace(self, nullable=nullable)
        parts = [(max(a, c), min(b, d)) for a, b in self.parts for c, d in other.parts if max(a, c) <= min(b, d)]
        return Bounds(_merged(parts), nullable)

    def null(self, nullable: bool = True) -> Bounds:
        return replace(self, nullable=nullable)

    def absolute(self) -> float | None:
        """The largest absolute value; None if it is unknown or infinite."""
        if not self.known or any(isinstance(x, str) for p in self.parts for x in p):
            return None
        try:
            most = max((abs(float(x)) for p in self.parts for x in p), default=0.0)
        except TypeError:
            return None
        return most if math.isfinite(most) else None


def _comparable(a: Bounds, b: Bounds) -> bool:
    try:
        return not (a.parts and b.parts) or (a.low <= b.high or True)
    except TypeError:
        return False


def _merged(parts: Iterable) -> tuple:
    out: list = []
    for a, b in sorted(p for p in parts if not p[0] > p[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return ((out[0][0], out[-1][1]),) if len(out) > CAPACITY else tuple(out)


BOOL = Bounds.of(False, True)
UNKNOWN = Bounds()


def pointwise(f: Callable, args: list[Bounds], codomain: Bounds = UNKNOWN) -> Bounds:
    """The image of finite sets by enumeration, else the codomain."""
    nullable = any(a.nullable for a in args)
    if all(a.finite for a in args) and math.prod(len(a.parts) for a in args) <= CAPACITY:
        try:
            return Bounds.of(*{f(*x) for x in product(*(a.values() for a in args))}, nullable=nullable)
        except Exception:  # a value outside the function's domain
            return codomain.null(True)
    return codomain.null(nullable or codomain.nullable)


def monotone(f: Callable, args: list[Bounds], blocks: list[list[tuple]] | None = None, codomain: Bounds = UNKNOWN) -> Bounds:
    """The image of a function that is monotone in each argument within each block.

    blocks lists, for each argument, the intervals between which the direction
    may change; without blocks the function is monotone everywhere.
    """
    nullable = any(a.nullable for a in args)
    if not all(a.known for a in args):
        return codomain.null(nullable or codomain.nullable)
    cut = []
    for i, a in enumerate(args):
        own = blocks[i] if blocks else [(-INF, INF)]
        cut.append([(max(x, c), min(y, d)) for x, y in a.parts for c, d in own if max(x, c) <= min(y, d)])
    out = []
    if math.prod(map(len, cut)) > CAPACITY:
        cut = [[(max(a.low, c), min(a.high, d)) for c, d in (blocks[i] if blocks else [(-INF, INF)]) if max(a.low, c) <= min(a.high, d)] for i, a in enumerate(args)]
    for box in product(*cut):
        try:
            ends = [f(*corner) for corner in product(*box)]
        except Exception:  # outside the domain, e.g. an overflow
            return codomain.null(True)
        if any(isinstance(e, float) and math.isnan(e) for e in ends):
            return codomain.null(True)
        out.append((min(ends), max(ends)))
    return Bounds(_merged(out), nullable)

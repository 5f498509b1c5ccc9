import math

from hypothesis import example, given, settings
from hypothesis import strategies as st

from veilframe.plans.bounds import CAPACITY, Bounds
from veilframe.plans.expr import bounds_of, col, fn, lit, narrow

NUMBERS = st.floats(-1000, 1000, allow_nan=False)
PY = {"plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b if abs(b) >= 1e-12 else 0.0, "least": min, "greatest": max}


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(PY)), st.tuples(NUMBERS, NUMBERS), st.tuples(NUMBERS, NUMBERS), st.floats(0, 1), st.floats(0, 1))
@example("divide", (1.0, 1.0), (1e-300, 1.0), 0.0, 0.0)
def test_values_fall_in_the_inferred_range(name, x, y, p, q):
    x, y = tuple(sorted(x)), tuple(sorted(y))
    a, b = x[0] + p * (x[1] - x[0]), y[0] + q * (y[1] - y[0])
    a, b = min(max(a, x[0]), x[1]), min(max(b, y[0]), y[1])
    found = bounds_of(fn(name, col("a"), col("b")), {"a": Bounds.of(x), "b": Bounds.of(y)})
    value = PY[name](a, b)
    slack = 1e-6 * max(1.0, abs(value))
    assert found.low - slack <= value <= found.high + slack


def test_interval_sets():
    assert Bounds.of((0, 2), (1, 3), 5).parts == ((0, 3), (5, 5))
    assert len(Bounds.of(*range(0, 2 * CAPACITY + 2, 2)).parts) == 1
    assert Bounds.of((0, 5)).intersect(Bounds.of((3, 9))).parts == ((3, 5),)
    assert Bounds.of(1, 2).subset(Bounds.of((0, 3))) and not Bounds.of((0, 4)).subset(Bounds.of((0, 3)))
    assert Bounds.of((-7, 3)).absolute() == 7 and Bounds.of((0, math.inf)).absolute() is None and Bounds.of("a").absolute() is None


def test_predicates_narrow():
    f = {"a": Bounds.of((0, 10)), "b": Bounds.of("x", "y", "z")}
    assert narrow(f, (col("a") > 3) & (col("a") <= 5))["a"].parts == ((3, 5),)
    assert narrow(f, col("b").isin("x", "z"))["b"].values() == ["x", "z"]
    assert narrow(f, (col("a") < 2) | (col("a") > 8))["a"].parts == ((0, 2), (8, 10))
    assert narrow(f, lit(False))["a"].empty

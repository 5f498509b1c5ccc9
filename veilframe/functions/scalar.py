"""Scalar functions: Spark columns with this engine's semantics, and their ranges.

Where Spark's function of that name means something else (base of log, rounding
of casts, day of week, division by zero) the column below holds the engine's
meaning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.bounds import BOOL, INF, Bounds, monotone, pointwise

#: Divisors nearer to zero give 0.
EPSILON = 1e-12


@dataclass(frozen=True)
class Function:
    name: str
    column: Callable[..., Column]
    image: Callable[[list[Bounds]], Bounds]
    type: str | Callable  # of the result; or from the arguments' types
    low: int = 1
    high: int = 1
    infix: str | None = None
    one_to_one: bool = False


REGISTRY: dict[str, Function] = {}


def _add(name, column, image=None, type="float", arity=1, infix=None, one_to_one=False, codomain=None, f=None):
    low, high = arity if isinstance(arity, tuple) else (arity, arity)
    if image is None:
        over = codomain or Bounds()
        image = (lambda a: pointwise(f, a, over)) if f else (lambda a: over.null(over.nullable or any(x.nullable for x in a)))
    for n in name.split():
        REGISTRY[n] = Function(n, column, image, type, low, high, infix, one_to_one)


def same(types):
    return "float" if "float" in types else types[0]


def _mono(f, blocks=None, codomain=None):
    return lambda a: monotone(f, a, blocks, codomain or Bounds())


SIGNS = [(-INF, 0), (0, INF)]


def _zero(x):
    return 0 if math.isnan(x) else x


def divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where the divisor is 0 or null."""
    b = b.cast("double")
    return F.when((b >= EPSILON) | (b <= -EPSILON), a.cast("double") / b).otherwise(F.lit(0.0))


def _divide_image(a):
    x, y = a
    if not (x.known and y.known):
        return Bounds(None, x.nullable)
    parts = [(p, q) for p, q in y.parts]
    clear = [(max(p, c), min(q, d)) for p, q in parts for c, d in ((-INF, -EPSILON), (EPSILON, INF)) if max(p, c) <= min(q, d)]
    out = monotone(lambda u, v: _zero(u / v), [x, Bounds(tuple(clear))], [SIGNS, SIGNS]) if clear else Bounds(())
    whole = out.union(Bounds.of(0.0)) if any(p < EPSILON and q > -EPSILON for p, q in parts) or y.nullable else out
    return whole.null(x.nullable)


# arithmetic, comparison, logic
_add("opposite", lambda x: -x, _mono(lambda x: -x), same, one_to_one=True)
_add("not", lambda p: ~p, lambda a: pointwise(lambda p: not p, a, BOOL), "boolean")
_add("plus", lambda a, b: a + b, _mono(lambda a, b: a + b), same, 2, "+")
_add("minus", lambda a, b: a - b, _mono(lambda a, b: a - b), same, 2, "-")
_add("multiply", lambda a, b: a * b, _mono(lambda a, b: _zero(a * b), [SIGNS, SIGNS]), same, 2, "*")
_add("divide", divide, _divide_image, "float", 2, "/")
_add("modulo", lambda a, b: a % b, lambda a: pointwise(lambda x, y: math.fmod(x, y), a), same, 2, "%")
_add("string_concat", lambda a, b: F.concat(a, b), None, "text", 2, "||", f=lambda a, b: a + b)


def _compare(f, sure, never):
    def image(a):
        x, y = a
        nullable = x.nullable or y.nullable
        if x.parts and y.parts:
            try:
                if sure(x, y):
                    return Bounds.of(True, nullable=nullable)
                if never(x, y):
                    return Bounds.of(False, nullable=nullable)
            except TypeError:
                pass
        return BOOL.null(nullable)

    return image


_add("gt", lambda a, b: a > b, _compare(None, lambda x, y: x.low > y.high, lambda x, y: x.high <= y.low), "boolean", 2, ">")
_add("lt", lambda a, b: a < b, _compare(None, lambda x, y: x.high < y.low, lambda x, y: x.low >= y.high), "boolean", 2, "<")
_add("gt_eq", lambda a, b: a >= b, _compare(None, lambda x, y: x.low >= y.high, lambda x, y: x.high < y.low), "boolean", 2, ">=")
_add("lt_eq", lambda a, b: a <= b, _compare(None, lambda x, y: x.high <= y.low, lambda x, y: x.low > y.high), "boolean", 2, "<=")
_add("eq", lambda a, b: a == b, lambda a: pointwise(lambda x, y: x == y, a, BOOL), "boolean", 2, "=")
_add("not_eq", lambda a, b: a != b, lambda a: pointwise(lambda x, y: x != y, a, BOOL), "boolean", 2, "<>")
_add("and", lambda p, q: p & q, lambda a: pointwise(lambda x, y: x and y, a, BOOL), "boolean", 2, "AND")
_add("or", lambda p, q: p | q, lambda a: pointwise(lambda x, y: x or y, a, BOOL), "boolean", 2, "OR")
_add("xor", lambda p, q: p != q, lambda a: pointwise(lambda x, y: x != y, a, BOOL), "boolean", 2, "XOR")
_add("bitwise_or", lambda a, b: a.bitwiseOR(b), None, "integer", 2, "|", f=lambda a, b: a | b)
_add("bitwise_and", lambda a, b: a.bitwiseAND(b), None, "integer", 2, "&", f=lambda a, b: a & b)
_add("bitwise_xor", lambda a, b: a.bitwiseXOR(b), None, "integer", 2, "^", f=lambda a, b: a ^ b)
_add("in_list", lambda x, *v: x.isin(*v), lambda a: BOOL.null(a[0].nullable), "boolean", (2, 10_000))
# conditional, null
_add("case", lambda p, a, b: F.when(p, a).otherwise(b), lambda a: a[1] if a[0].parts == ((True, True),) and not a[0].nullable else a[2] if a[0].parts == ((False, False),) else a[1].union(a[2]), lambda t: same(t[1:]), 3)
_add("coalesce", lambda *c: F.coalesce(*c), lambda a: _coalesced(a), same, (1, 100))
_add("is_null", lambda x: x.isNull(), lambda a: BOOL if a[0].nullable else Bounds.of(False), "boolean")
_add("is_bool", lambda x, v: to_boolean(x).eqNullSafe(v), None, "boolean", 2, codomain=BOOL)
_add("choose", lambda i, *v: F.get(F.array(*v), i), lambda a: _union(a[1:]).null(), lambda t: same(t[1:]), (2, 1000))
_add("least", lambda a, b: F.least(a, b), _mono(min), same, 2)
_add("greatest", lambda a, b: F.greatest(a, b), _mono(max), same, 2)


def _union(bounds):
    out = bounds[0]
    for b in bounds[1:]:
        out = out.union(b)
    return out


def _coalesced(a):
    return _union(a).null(all(x.nullable for x in a))


# math
_add("exp", F.exp, _mono(lambda x: math.exp(x) if x < 700 else INF), "float", one_to_one=True)
_add("ln", F.ln, _mono(lambda x: math.log(x) if x > 0 else -INF), "float", one_to_one=True)
_add("log", lambda *a: F.log10(a[0]) if len(a) == 1 else F.log10(a[1]) / F.log10(a[0]), None, "float", (1, 2))
_add("log2", F.log2, _mono(lambda x: math.log2(x) if x > 0 else -INF))
_add("log10", F.log10, _mono(lambda x: math.log10(x) if x > 0 else -INF))
_add("abs", F.abs, _mono(abs, [SIGNS]), same)
_add("sin", F.sin, None, codomain=Bounds.of((-1.0, 1.0)), f=math.sin)
_add("cos", F.cos, None, codomain=Bounds.of((-1.0, 1.0)), f=math.cos)
_add("tan", F.tan, None, f=math.tan)
_add("sqrt", F.sqrt, _mono(math.sqrt, [[(0, INF)]]))
_add("pow power", lambda a, b: F.pow(a, b), lambda a: monotone(lambda x, y: x**y, a, [[(0, 1), (1, INF)], SIGNS]) if a[0].parts and isinstance(a[0].low, (int, float)) and a[0].low >= 0 else Bounds(None, any(x.nullable for x in a)), "float", 2)
_add("square", lambda x: F.pow(x, F.lit(2)), _mono(lambda x: x * x, [SIGNS]))
_add("round", lambda x, n=None: F.round(x) if n is None else F.round(x, n), lambda a: _rounded(a), same, (1, 2))
_add("trunc truncate", lambda x, n=None: _trunc(x, n), lambda a: _rounded(a), same, (1, 2))
_add("ceil ceiling", F.ceil, _mono(math.ceil), "integer")
_add("floor", F.floor, _mono(math.floor), "integer")
_add("sign", lambda x: F.when(x > 0, F.lit(1).cast("bigint")).when(x < 0, F.lit(-1).cast("bigint")).when(x == 0, F.lit(0).cast("bigint")), _mono(lambda x: (x > 0) - (x < 0)), "integer")
_add("degrees", F.degrees, _mono(math.degrees), "float", one_to_one=True)
_add("pi", lambda: F.pi(), lambda a: Bounds.of(math.pi), "float", 0)
_add("random rand", lambda seed=None: F.rand(), lambda a: Bounds.of((0.0, 1.0)), "float", (0, 1))


def _rounded(a):
    return monotone(lambda x: x, [Bounds(tuple((math.floor(p), math.ceil(q)) for p, q in a[0].parts) if a[0].known and all(math.isfinite(z) for p in a[0].parts for z in p) else a[0].parts, a[0].nullable)])


def _trunc(x: Column, n) -> Column:
    scale = F.lit(1.0) if n is None else F.pow(F.lit(10.0), n)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


# text
_text = lambda c: c.cast("string")
_add("concat", lambda *c: F.concat(*map(_text, c)), None, "text", (1, 100))
_add("char_length length", F.char_length, None, "integer", codomain=Bounds.of((0, 2**31)), f=len)
_add("lower", F.lower, None, "text", f=str.lower)
_add("upper", F.upper, None, "text", f=str.upper)
_add("md5", lambda x: F.md5(_text(x)), None, "text", one_to_one=True)
_add("position", lambda a, b: F.call_function("locate", a, b), None, "integer", 2, codomain=Bounds.of((0, 2**31)), f=lambda a, b: b.find(a) + 1)
_add("rtrim", lambda s, c=None: F.rtrim(s) if c is None else F.rtrim(s, c), None, "text", (1, 2))
_add("ltrim", lambda s, c=None: F.ltrim(s) if c is None else F.ltrim(s, c), None, "text", (1, 2))
_add("btrim trim", lambda s, c=None: F.btrim(s) if c is None else F.btrim(s, c), None, "text", (1, 2))
_add("substr substring", lambda s, i, n=None: F.substring(s, i, F.lit(2147483647) if n is None else n), None, "text", (2, 3))
_add("regexp_contains", lambda s, p: F.regexp_like(s, p), None, "boolean", 2, codomain=BOOL)
_add("regexp_extract regexp_substr", lambda s, p, pos=None, occ=None: F.try_element_at(F.regexp_extract_all(s if pos is None else F.substring(s, pos, F.lit(2147483647)), p, F.lit(0)), F.lit(1) if occ is None else occ), None, "text", (2, 4))
_add("regexp_replace", lambda s, p, r: F.regexp_replace(s, p, r), None, "text", 3)
_add("newid uuid", lambda: F.expr("uuid()"), None, "text", 0)
_add("encode", lambda s, fmt: _coder(s, fmt, True), None, "text", 2)
_add("decode", lambda s, fmt: _coder(s, fmt, False), None, "text", 2)
_add("unhex from_hex", lambda s: F.decode(F.unhex(s), "UTF-8"), None, "text")
_add("like", lambda s, p: F.call_function("like", s, p), None, "boolean", 2, "LIKE", codomain=BOOL)
_add("ilike", lambda s, p: F.call_function("ilike", s, p), None, "boolean", 2, "ILIKE", codomain=BOOL)


def _coder(s: Column, fmt: Column, there: bool) -> Column:
    if there:
        return F.when(fmt == "hex", F.lower(F.hex(s))).when(fmt == "base64", F.base64(s.cast("binary"))).otherwise(s)
    return F.when(fmt == "hex", F.decode(F.unhex(s), "UTF-8")).when(fmt == "base64", F.decode(F.unbase64(s), "UTF-8")).otherwise(s)


# casts
#: Texts that mean true and false.
TRUE_TEXTS = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
FALSE_TEXTS = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")


def to_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)


_add("cast_text", _text, None, "text", one_to_one=True, f=str)
_add("cast_float", lambda x: x.cast("double"), lambda a: a[0] if a[0].absolute() is not None else Bounds(None, a[0].nullable), "float")
_add("cast_integer", lambda x: F.round(x.cast("double")).cast("bigint"), lambda a: _rounded(a) if a[0].absolute() is not None else Bounds(None, a[0].nullable), "integer")
_add("cast_boolean", to_boolean, None, "boolean", codomain=BOOL.null())
_add("cast_date date", lambda x: F.to_date(x), None, "date")
_add("cast_time", lambda x: F.date_format(x.cast("timestamp_ntz"), "HH:mm:ss"), None, "text")
_add("cast_datetime", lambda x: x.cast("timestamp_ntz"), None, "datetime")
# date and time
_add("current_date", lambda: F.current_date(), None, "date", 0)
_add("current_time", lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"), None, "text", 0)
_add("current_timestamp", lambda: F.current_timestamp(), None, "datetime", 0)
_second = lambda x: F.expr("1") * F.date_part(F.lit("SECOND"), x)
_add("extract_epoch", lambda x: F.unix_timestamp(x), None, "integer")
_add("extract_year", F.year, None, "integer")
_add("extract_month", F.month, None, "integer", codomain=Bounds.of((1, 12)))
_add("extract_day", F.dayofmonth, None, "integer", codomain=Bounds.of((1, 31)))
_add("extract_hour", F.hour, None, "integer", codomain=Bounds.of((0, 23)))
_add("extract_minute", F.minute, None, "integer", codomain=Bounds.of((0, 59)))
_add("extract_second", F.second, None, "integer", codomain=Bounds.of((0, 59)))
_add("extract_microsecond", lambda x: (_second(x) * 1_000_000).cast("bigint"), None, "integer", codomain=Bounds.of((0, 59_999_999)))
_add("extract_millisecond", lambda x: (_second(x) * 1000).cast("double"), None, "float", codomain=Bounds.of((0, 60_000)))
_add("extract_dow", lambda x: F.dayofweek(x) - 1, None, "integer", codomain=Bounds.of((0, 6)))
_add("extract_week", F.weekofyear, None, "integer", codomain=Bounds.of((1, 53)))
_add("dayname", lambda x: F.date_format(x, "EEEE"), None, "text", codomain=Bounds.of("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))
_add("quarter", F.quarter, None, "integer", codomain=Bounds.of((1, 4)))
_add("unix_timestamp", lambda x=None: F.unix_timestamp() if x is None else F.unix_timestamp(x), None, "integer", (0, 1))
_add("datetime_diff", lambda a, b, unit: None, None, "integer", 3)  # built by the expression, which knows the unit
_add("from_unixtime", lambda n, fmt=None: None, None, "text", (1, 2))
_add("date_format", lambda x, fmt: None, None, "text", 2)

#: MySQL date tokens and the Java patterns for them.
TOKENS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "E", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%"}


def java_pattern(fmt: str) -> str:
    """A Java date pattern for one with % tokens; what stands between tokens is quoted."""
    out, plain, i = "", "", 0
    while i <= len(fmt):
        token = TOKENS.get(fmt[i : i + 2])
        if (token is not None or i == len(fmt)) and plain:
            out += "'" + plain.replace("'", "''") + "'" if any(c not in " -/:.,0123456789" for c in plain) else plain
            plain = ""
        if token is None:
            plain += fmt[i : i + 1]
            i += 1
        else:
            out += token
            i += 2
    return out

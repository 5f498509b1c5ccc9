import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import veilframe.queries as q
from veilframe.operators import transforms as t
from veilframe.plans.bounds import Bounds
from veilframe.plans.dialects import DIALECTS, query
from veilframe.plans.expr import agg, col, fn
from veilframe.plans.nodes import table
from veilframe.plans.sql import base_tables, parse
from veilframe.privacy import ledger
from veilframe.privacy.rules import rewrite_as_tracked, rewrite_with_dp
from veilframe.privacy.unit import UNIT, PrivacyUnit, Unreachable
from veilframe.sources.catalog import Catalog, create_table_sql, insert_sql, random_rows, same_rows

TABLES = "region nation customer supplier part orders lineitem events".split()


def value(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) or v is None else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"create view {n} as select * from '{data}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(spark, data, duck, name):
    df = q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(value(v) for v in r) for r in df.select(columns).collect()), key=str)
    out = duck.execute(q.ORACLE[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(value(float(r[names.index(c)])) if type(r[names.index(c)]).__name__ == "Decimal" else value(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=str)
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_noisy_query_runs(spark, data, name):
    q.QUERIES[name](spark, data).collect()


def test_unsupported_sql_raises():
    tables = {"x": table("x", {"a": "integer"})}
    for text in ("SELECT sum(a) OVER () FROM x", "SELECT a FROM x WHERE a IN (SELECT a FROM x)", "SELECT (SELECT a FROM x) FROM x", "SELECT b FROM x", "SELECT foo(a) FROM x"):
        with pytest.raises((ValueError, KeyError)):
            parse(text, tables)
    assert base_tables("WITH a AS (SELECT * FROM p.x) SELECT * FROM a JOIN y ON 1 = 1") == {"p.x", "y"}


def test_names_resolve_by_suffix():
    tables = {"db.x": table("db.x", {"Na.Me": "integer"})}
    assert parse('SELECT "Na.Me" AS n FROM x', tables).names == ["n"]


def test_size_and_uniqueness():
    a = table("a", {"k": ("integer", Bounds.of((0, 9)), True), "v": ("float", Bounds.of((0.0, 2.0)))}, (10, 10))
    r = parse("SELECT x.k, y.v FROM a x JOIN a y ON x.k = y.k", {"a": a})
    assert r.size[1] == 10 and r["k"].unique
    g = a.group_by("k", s=agg("sum", "v"), n=agg("count"))
    assert g["n"].bounds.contains(10) and g["s"].bounds.contains(20.0)
    assert a.filter(col("v") > 1.0)["v"].bounds.parts == ((1.0, 2.0),)
    assert "Reduce" in g.describe() and g.dot().startswith("digraph")


def test_every_dialect_prints():
    a = table("s.a", {"k": "integer", "v": "float"})
    r = parse("SELECT k, md5(k) AS m, sum(v) / count(*) AS x FROM a WHERE v > 1 GROUP BY k, m ORDER BY k LIMIT 3", {"a": a})
    for d in DIALECTS:
        assert query(r, d).startswith("WITH")


def test_calibration():
    assert math.isclose(ledger.noise_multiplier(1, 1e-3), 3.77648, rel_tol=1e-5)
    assert math.isclose(ledger.tau(0.5, 5e-4, 5), 66.7912, rel_tol=1e-5)
    e = ledger.NoOp().compose(ledger.Gaussian(2)).compose(ledger.Composed((ledger.Gaussian(3), ledger.Gaussian(4))))
    assert e == ledger.Composed((ledger.Gaussian(2), ledger.Gaussian(3), ledger.Gaussian(4)))


def test_noise_has_its_moments(spark):
    rows = spark.range(100_000).select(F.lit(0.0).alias("x"))
    got = t.add_gaussian_noise(rows, {"x": 2.0}).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(got[0]) < 5 * 2 / math.sqrt(1e5) and abs(got[1] - 2) < 0.05


def test_clip_limits_what_a_unit_changes(spark):
    rows = [(u, g, float(10 * u + g)) for u in range(8) for g in range(4)]
    df = spark.createDataFrame(rows, "unit long, g long, v double")
    whole = {r.g: r.v for r in t.l2_clipped_sums(df, "unit", ["g"], {"v": 5.0}).collect()}
    for u in range(8):
        rest = {r.g: r.v for r in t.l2_clipped_sums(df.where(F.col("unit") != u), "unit", ["g"], {"v": 5.0}).collect()}
        assert math.sqrt(sum((whole[g] - rest[g]) ** 2 for g in whole)) <= 5.0 + 1e-9


def test_distinct_values_of_a_unit_are_limited(spark):
    # unit 0 has each value together with one other unit; without it the values must not count for more
    rows = [(0, v) for v in range(300)] + [(v + 1, v) for v in range(300)] + [(0, v) for v in range(300, 600)]
    unit, par = PrivacyUnit.of({"a": ([], "u")}), ledger.Parameters(1, 1e-3, max_multiplicity=10.0)
    found = []
    for kept in (rows, [x for x in rows if x[0]], [x for x in rows if x[0] != 5]):
        c = Catalog()
        c.add("a", spark.createDataFrame([(u, float(v)) for u, v in kept], "u long, v double"), {"v": Bounds.of((0.0, 1000.0))}, set())
        out = rewrite_with_dp(c.sql("SELECT count(DISTINCT v) AS n, sum(DISTINCT v) AS s FROM a"), unit, c.tables, par, draw=lambda sigma: F.lit(0.0)).relation
        found.append(out.dataframe(spark).collect()[0])
    whole = found[0]
    assert whole.n in range(300, 311)
    for x in found[1:]:
        assert abs(whole.n - x.n) <= 10 and abs(whole.s - x.s) <= 10 * 1000.0


def test_ledger_does_not_depend_on_bounds():
    unit = PrivacyUnit.of({"a": ([], "u")})
    found = []
    for top in (1.0, 100.0):
        tables = {"a": table("a", {"u": "integer", "v": ("float", Bounds.of((-top, top)))}, 100)}
        r = parse("SELECT sum(v) AS s FROM a", tables)
        found.append(rewrite_with_dp(r, unit, tables, ledger.Parameters(1, 1e-3)).event)
    assert found[0] == found[1] == ledger.Gaussian(ledger.noise_multiplier(1, 1e-3))


def test_rules():
    tables = {"a": table("a", {"u": "integer", "v": ("float", Bounds.of((0.0, 1.0)))}, 100), "p": table("p", {"u": "integer", "w": "text"}, 10)}
    unit = PrivacyUnit.of({"a": ([], "u")})
    par = ledger.Parameters(1, 1e-3)
    assert rewrite_with_dp(parse("SELECT w FROM p", tables), unit, tables, par).prop == "public"
    assert rewrite_with_dp(parse("SELECT sum(v) AS s FROM a", tables), unit, tables, par).prop == "published"
    with pytest.raises(Unreachable):
        rewrite_with_dp(parse("SELECT v FROM a", tables), unit, tables, par)
    with pytest.raises(Unreachable):
        rewrite_with_dp(parse("SELECT min(v) AS m FROM a", tables), unit, tables, par)
    assert rewrite_with_dp(parse("SELECT v FROM a", tables), unit, tables, par, {"a": tables["a"]}).prop == "synthetic"
    assert rewrite_as_tracked(parse("SELECT v FROM a", tables), unit, tables).relation.names[0] == UNIT
    with pytest.raises(Unreachable):
        rewrite_as_tracked(parse("SELECT sum(v) AS s FROM a", tables), unit, tables, hard=False)
    free = {"a": table("a", {"u": "integer", "v": "float"}, 100)}
    with pytest.raises(ValueError, match="clipping"):
        rewrite_with_dp(parse("SELECT sum(v) AS s FROM a", free), unit, free, par)


def test_generated_rows_and_ddl(spark):
    r = table("g", {"i": ("integer", Bounds.of((3, 9))), "s": ("text", Bounds.of("a", "b")), "d": ("date", Bounds.of((datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)))), "k": ("integer", None, True)}, 50)
    rows = random_rows(spark, r, 50).collect()
    assert all(3 <= x.i <= 9 and x.s in "ab" and x.d.year == 2020 for x in rows) and len({x.k for x in rows}) == 50
    assert "BIGINT NOT NULL" in create_table_sql(r, "g") and insert_sql(r, "g").count("?") == 4
    df = spark.range(5)
    assert same_rows(df, df) and not same_rows(df, df.union(df))


def test_scalar_edges(spark):
    c = Catalog()
    c.add("x", spark.createDataFrame([(1, 0.0, None), (2, 4.0, "on")], "k long, v double, s string"))
    rows = c.run(spark, "SELECT k, 1 / v AS inv, CAST(v + 0.5 AS BIGINT) AS r, CAST(s AS BOOLEAN) AS b, s IS NOT TRUE AS nt, trunc(-1.57, 1) AS t FROM x ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0, 1, None, True, -1.5), (2, 0.25, 5, True, False, -1.5)]
    assert fn("plus", col("a"), 1) == fn("plus", col("a"), 1)


def test_stream_of_windows(spark, tmp_path):
    from veilframe.streaming.windows import windowed_units

    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), u) for m in range(8) for u in (1, 2)], "ts timestamp, u long")
    assert {r.n for r in windowed_units(df, "ts", "u", []).collect()} == {5}

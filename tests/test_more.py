"""Names, graphs, sinks, samples, natural joins, weights and streams."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.operators import transforms as t
from veilframe.plans.bounds import Bounds
from veilframe.plans.dialects import DIALECTS, query
from veilframe.plans.expr import agg, col, fn
from veilframe.plans.nodes import join, natural_join, table, values
from veilframe.plans.sql import parse
from veilframe.privacy import ledger
from veilframe.privacy.rules import Rewriter, dp_operators, rewrite_as_tracked, rewrite_with_dp
from veilframe.privacy.unit import UNIT, WEIGHT, PrivacyUnit
from veilframe.sources.catalog import Catalog, Database, create_table_sql, insert_sql
from veilframe.streaming.windows import windowed_units


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names_and_ordered_groups(spark):
    c = Catalog()
    c.add("a", spark.createDataFrame([(2, 1.0), (1, 2.0), (2, 4.0)], "k long, v double"))
    r = c["a"].with_name("mine").ordered_reduce("k", s=agg("sum", "v"))
    assert [tuple(x) for x in r.dataframe(spark).collect()] == [(1, 2.0), (2, 5.0)]
    assert "`mine_1` AS" in query(r) and "mine" in r.describe() and "mine" in r.compose({}).describe()
    assert c["a"].with_name("mine").dataframe(spark).select("mine.k").count() == 3


def test_graphs_hold_ranges_and_rules():
    a = table("a", {"u": "integer", "v": ("float", Bounds.of((0.0, 2.0)), True)}, 100)
    assert "[0.0, 2.0]" in a.dot() and "unique" in a.dot()
    text = (col("v") + 1.0).dot(a.bounds())
    assert "[1.0, 3.0]" in text and text.count("->") == 2
    unit, par = PrivacyUnit.of({"a": ([], "u")}), ledger.Parameters(1, 1e-3)
    r = parse("SELECT sum(v) AS s FROM a", {"a": a})
    assert "tracked -> dp" in Rewriter(unit, {"a": a}, par).dot(r)
    assert dp_operators(rewrite_with_dp(r, unit, {"a": a}, par).relation) == 1 and dp_operators(r) == 0


@pytest.mark.parametrize("dialect", sorted(DIALECTS))
def test_tables_of_each_dialect(dialect):
    kinds = ("boolean", "integer", "float", "text", "bytes", "date", "datetime", "time", "duration")
    r = table("t", {k: (k, Bounds(None, k != "text")) for k in kinds})
    text = create_table_sql(r, "t", dialect)
    assert text.count("NOT NULL") == 1 and "SIGNED" not in text
    assert len(insert_sql(r, "t", dialect).split("VALUES")[1].split(",")) == len(kinds)


def test_sqlite_table_takes_rows():
    import sqlite3

    r = table("t", {"k": ("integer", Bounds(None, False)), "s": "text"})
    con = sqlite3.connect(":memory:")
    con.execute(create_table_sql(r, "t", "sqlite"))
    con.execute(insert_sql(r, "t", "sqlite"), (1, "a"))
    assert con.execute(query(r, "sqlite")).fetchall() == [(1, "a")]
    with pytest.raises(sqlite3.IntegrityError):
        con.execute(insert_sql(r, "t", "sqlite"), (None, "a"))


def test_settings_of_databases(spark):
    d = Database("postgresql", "shop", "db.example", options=(("user", "me"),))
    assert d.settings("s.t") == {"url": "jdbc:postgresql://db.example:5432/shop", "driver": "org.postgresql.Driver", "dbtable": "s.t", "user": "me"}
    assert Database("mssql", "shop").settings("t")["url"] == "jdbc:sqlserver://localhost:1433;databaseName=shop"
    with pytest.raises(Exception, match="sqlite"):  # no such driver here
        Database("sqlite", "/nowhere.db").read(spark, "t").collect()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_natural_joins(spark, how):
    left, right = [(1, "a", 10), (2, "b", 20), (2, "c", 21), (None, "d", 30)], [(2, "b", 200), (3, "a", 300), (1, "a", 100), (None, "d", 1)]
    con, c = duckdb.connect(), Catalog()
    for n, data, v in (("l", left, "x"), ("r", right, "y")):
        con.execute(f"create table {n} (k bigint, s varchar, {v} bigint)")
        con.executemany(f"insert into {n} values (?, ?, ?)", data)
        c.add(n, spark.createDataFrame(data, f"k long, s string, {v} long"))
    text = f"SELECT k, s, x, y FROM l NATURAL {how.upper()} JOIN r"
    wanted = sorted(con.execute(text).fetchall(), key=str)
    assert rows(c.run(spark, text)) == wanted
    assert rows(natural_join(c["l"], c["r"], how).select("k", "s", "x", "y").dataframe(spark)) == wanted


def test_weights_follow_their_rows(spark):
    c = Catalog()
    c.add("a", spark.createDataFrame([(1, 2.0, 5), (1, 3.0, 6), (2, 0.5, 7)], "u long, w double, v long"))
    c.add("b", spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "v long, g long"))
    unit = PrivacyUnit.of({"a": ([], "u", "w"), "b": ([("v", "a", "v")], "u", "w")}, hashed=False)
    got = rewrite_as_tracked(c.sql("SELECT v FROM a"), unit, c.tables).relation
    assert got.names == [UNIT, WEIGHT, "v"]
    assert rows(got.dataframe(spark)) == [(1, 2.0, 5), (1, 3.0, 6), (2, 0.5, 7)]
    assert rows(rewrite_as_tracked(c.sql("SELECT g FROM b"), unit, c.tables).relation.dataframe(spark)) == [(1, 2.0, 1), (1, 3.0, 1), (2, 0.5, 2)]
    groups = rewrite_as_tracked(c.sql("SELECT g, count(*) AS n FROM b GROUP BY g"), unit, c.tables).relation
    assert rows(groups.dataframe(spark)) == [(1, 5.0, 1, 2), (2, 0.5, 2, 1)]
    both = rewrite_as_tracked(c.sql("SELECT x.v AS v, y.g AS g FROM a x JOIN b y ON x.v = y.v"), unit, c.tables).relation
    assert rows(both.dataframe(spark)) == [(1, 4.0, 5, 1), (1, 9.0, 6, 1), (2, 0.25, 7, 2)]


@pytest.mark.parametrize("word", ["UNION ALL", "UNION", "INTERSECT", "EXCEPT"])
def test_tracked_set_operations(spark, word):
    c = Catalog()
    c.add("a", spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "u long, v long"))
    c.add("b", spark.createDataFrame([(1, 5), (2, 6), (2, 6)], "u long, v long"))
    unit = PrivacyUnit.of({"a": ([], "u"), "b": ([], "u")}, hashed=False)
    got = rewrite_as_tracked(c.sql(f"SELECT v FROM a {word} SELECT v FROM b"), unit, c.tables).relation
    a, b = [(1, 1, 5), (1, 1, 6), (2, 1, 5)], [(1, 1, 5), (2, 1, 6), (2, 1, 6)]
    wanted = {"UNION ALL": a + b, "UNION": set(a) | set(b), "INTERSECT": set(a) & set(b), "EXCEPT": set(a) - set(b)}[word]
    assert rows(got.dataframe(spark)) == sorted(wanted, key=str)


def test_public_values_are_made_by_spark(spark):
    domains = {"a": Bounds.of(*range(40)), "b": Bounds.of("x", "y"), "c": Bounds.of(True, False), "d": Bounds.of(datetime.date(2024, 1, 1))}
    made = t.public_values(spark, domains)
    assert made.count() == made.distinct().count() == 160 and dict(made.dtypes) == {"a": "bigint", "b": "string", "c": "boolean", "d": "date"}
    with pytest.raises(ValueError, match="160 combinations"):
        t.public_values(spark, domains, 100)


@pytest.mark.parametrize("rate", [0.0, 0.01, 0.4, 0.9])
def test_samples_have_their_size(spark, rate):
    df = spark.range(20_000)
    got = [r.id for r in t.sampling_without_replacement(df, rate, 20_000, seed=5).collect()]
    assert len(got) == len(set(got)) == int(rate * 20_000)
    if rate >= 0.4:
        assert abs(sum(got) / len(got) - 10_000) < 300
    assert sorted(got) == sorted(r.id for r in t.sampling_without_replacement(df, rate, 20_000, seed=5).collect())


def test_stream_appends_closed_windows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    parts = [[(at + datetime.timedelta(minutes=m), u) for m in range(8) for u in (1, 2)], [(at + datetime.timedelta(hours=3), 1)], [(at + datetime.timedelta(hours=6), 1)]]
    schema = "ts timestamp, u long"
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = windowed_units(stream, "ts", "u", [], most=5).select(F.col("window.start").alias("start"), "u", "n")
    q = made.writeStream.format("memory").queryName("closed_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = rows(spark.table("closed_windows"))
    assert got == [(at, 1, 5), (at, 2, 5), (at + datetime.timedelta(hours=3), 1, 1)]


def test_joins_with_literal_values_deal_no_rows_by_them(spark):
    c = Catalog()
    c.add("a", spark.range(1000).selectExpr("id % 3 AS k", "id AS v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be sent
    try:
        for left, right in ((values("p", [1, 2]), c["a"]), (c["a"], values("p", [1, 2]))):
            df = join(left, right, fn("eq", col("p"), col("k"))).group_by("p", n=agg("count")).dataframe(spark)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert rows(df) == [(1, 333), (2, 333)] and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

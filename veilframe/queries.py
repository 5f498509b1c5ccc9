"""Queries over the engine's operators, each with the SQL of its result where that is deterministic."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import transforms as t
from .plans.bounds import Bounds
from .plans.expr import agg, col, fn
from .plans.nodes import join, set_op, values
from .privacy import sampling
from .privacy.ledger import Parameters, tau
from .privacy.rules import rewrite_as_tracked, rewrite_with_dp
from .privacy.unit import ROW, UNIT, PrivacyUnit
from .sources.catalog import Catalog

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: Declared facts of the schema.
DECLARED = {
    "lineitem": {"l_quantity": Bounds.of((1.0, 50.0)), "l_discount": Bounds.of((0.0, 0.1)), "l_tax": Bounds.of((0.0, 0.08)), "l_extendedprice": Bounds.of((0.0, 110000.0)), "l_returnflag": Bounds.of("A", "N", "R"), "l_linestatus": Bounds.of("F", "O")},
    "orders": {"o_totalprice": Bounds.of((0.0, 500000.0)), "o_orderpriority": Bounds.of(*PRIORITIES), "o_orderstatus": Bounds.of("F", "O", "P")},
    "events": {"value": Bounds.of((0.0, 1000.0))},
    "customer": {"c_acctbal": Bounds.of((-1000.0, 10000.0))},
}
UNIQUE = {"region": {"r_regionkey"}, "nation": {"n_nationkey"}, "customer": {"c_custkey"}, "supplier": {"s_suppkey"}, "part": {"p_partkey"}, "orders": {"o_orderkey"}, "events": {"event_id"}}
UNITS = PrivacyUnit.of({
    "customer": ([], "c_custkey"),
    "orders": ([], "o_custkey"),
    "lineitem": ([("l_orderkey", "orders", "o_orderkey")], "o_custkey"),
    "events": ([], "user_id"),
})


def catalog(spark, sf_dir) -> Catalog:
    c = Catalog()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.add(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), DECLARED.get(name), UNIQUE.get(name, set()), size=1e9)
    return c


#: name -> SQL that the engine runs, and the SQL of the same result where it reads otherwise.
SQL: dict[str, str | tuple[str, str]] = {
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem WHERE l_quantity > 45 AND l_shipdate BETWEEN CAST('1995-01-01' AS TIMESTAMP) AND CAST('1995-12-31' AS TIMESTAMP)",
    "guarded_division": ("SELECT l_orderkey, l_linenumber, l_tax / l_discount AS ratio FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) >= 1e-12 THEN l_tax / l_discount ELSE 0.0 END AS ratio FROM lineitem"),
    "case_coalesce_null": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'none') AS status, (o_totalprice > 200000) IS TRUE AS rich, o_orderpriority IS NULL AS no_priority FROM orders",) * 2,
    "math_functions": ("SELECT o_orderkey, ROUND(log(o_totalprice), 6) AS lg, ROUND(log2(o_totalprice), 6) AS l2, ROUND(ln(o_totalprice), 6) AS l, ROUND(exp(o_totalprice / 1000000), 6) AS ex, ROUND(sqrt(o_totalprice), 6) AS sq, ROUND(pow(o_totalprice, 0.25), 6) AS pw, sign(o_totalprice - 200000) AS sg, trunc(o_totalprice) AS tr, ROUND(degrees(o_totalprice / 1000000), 6) AS dg, ceil(o_totalprice) AS ce, floor(o_totalprice) AS fl, abs(o_totalprice - 200000) AS ab, ROUND(sin(o_totalprice / 1000), 6) AS sn, least(o_totalprice, 1000) AS le, greatest(o_totalprice, 1000) AS gr FROM orders",
        "SELECT o_orderkey, ROUND(log10(o_totalprice), 6) AS lg, ROUND(log2(o_totalprice), 6) AS l2, ROUND(ln(o_totalprice), 6) AS l, ROUND(exp(o_totalprice / 1000000), 6) AS ex, ROUND(sqrt(o_totalprice), 6) AS sq, ROUND(pow(o_totalprice, 0.25::DOUBLE), 6) AS pw, sign(o_totalprice - 200000)::BIGINT AS sg, trunc(o_totalprice) AS tr, ROUND(degrees(o_totalprice / 1000000), 6) AS dg, ceil(o_totalprice)::BIGINT AS ce, floor(o_totalprice)::BIGINT AS fl, abs(o_totalprice - 200000) AS ab, ROUND(sin(o_totalprice / 1000), 6) AS sn, least(o_totalprice, 1000) AS le, greatest(o_totalprice, 1000) AS gr FROM orders"),
    "string_functions": ("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, ltrim(c_name, 'C') AS lt, rtrim(c_name, '0') AS rt, btrim(c_mktsegment, 'AG') AS bt, substr(c_name, 3, 4) AS su, POSITION('#' IN c_name) AS po, concat(c_name, '-', c_custkey) AS co, c_name || c_mktsegment AS cc, char_length(c_mktsegment) AS le, md5(c_name) AS md, regexp_contains(c_name, '[0-9]+1$') AS rc, regexp_replace(c_name, '[0-9]', 'x') AS rr, c_name LIKE '%1%' AS li, c_mktsegment ILIKE '%au%' AS il, c_mktsegment IN ('BUILDING', 'MACHINERY') AS isin FROM customer",
        "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, ltrim(c_name, 'C') AS lt, rtrim(c_name, '0') AS rt, trim(c_mktsegment, 'AG') AS bt, substr(c_name, 3, 4) AS su, instr(c_name, '#')::INT AS po, concat(c_name, '-', c_custkey) AS co, c_name || c_mktsegment AS cc, length(c_mktsegment)::INT AS le, md5(c_name) AS md, regexp_matches(c_name, '[0-9]+1$') AS rc, regexp_replace(c_name, '[0-9]', 'x', 'g') AS rr, c_name LIKE '%1%' AS li, c_mktsegment ILIKE '%au%' AS il, c_mktsegment IN ('BUILDING', 'MACHINERY') AS isin FROM customer"),
    "encode_decode": ("SELECT c_custkey, encode(c_name, 'hex') AS h, encode(c_name, 'base64') AS b, decode(encode(c_name, 'hex'), 'hex') AS dh, decode(encode(c_name, 'base64'), 'base64') AS db, unhex(encode(c_name, 'hex')) AS u FROM customer",
        "SELECT c_custkey, lower(hex(encode(c_name))) AS h, base64(encode(c_name)) AS b, c_name AS dh, c_name AS db, c_name AS u FROM customer"),
    "regexp_occurrence": ("SELECT c_custkey, regexp_extract(c_name, '[0-9]', 1, 3) AS third FROM customer", "SELECT c_custkey, regexp_extract_all(c_name, '[0-9]')[3] AS third FROM customer"),
    "casts": ("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS s, CAST(CASE WHEN o_orderstatus = 'F' THEN 'on' WHEN o_orderstatus = 'O' THEN 'no' ELSE 'x' END AS BOOLEAN) AS b, CAST(o_orderdate AS DATE) AS d, choose(1, o_orderstatus, o_orderpriority) AS ch FROM orders",
        "SELECT o_orderkey, round(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS f, o_orderkey::VARCHAR AS s, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS b, o_orderdate::DATE AS d, o_orderpriority AS ch FROM orders"),
    "date_functions": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s, EXTRACT(DOW FROM ts) AS dow, EXTRACT(WEEK FROM ts) AS w, quarter(ts) AS q, dayname(ts) AS dn, EXTRACT(EPOCH FROM ts) AS ep, datetime_diff(ts, CAST('2020-01-01' AS TIMESTAMP), 'day') AS dd, date(ts) AS da, date_format(ts, '%Y/%m/%d') AS df FROM events",
        "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, dayofweek(ts)::INT AS dow, weekofyear(ts)::INT AS w, quarter(ts)::INT AS q, dayname(ts) AS dn, floor(epoch(ts))::BIGINT AS ep, date_sub('day', TIMESTAMP '2020-01-01', ts) AS dd, ts::DATE AS da, strftime(ts, '%Y/%m/%d') AS df FROM events"),
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "having": "SELECT o_custkey, count(*) AS n, ROUND(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1000000",
    "group_alias": ("SELECT EXTRACT(YEAR FROM o_orderdate) AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY year, status", "SELECT year(o_orderdate)::INT AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2"),
    "group_expr": "SELECT o_orderstatus, ROUND(sum(o_totalprice) / count(*), 2) AS mean, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY o_orderstatus",
    "agg_all": ("SELECT l_returnflag, min(l_quantity) AS mn, max(l_quantity) AS mx, ROUND(avg(l_extendedprice), 2) AS av, ROUND(sum(l_extendedprice), 2) AS su, count(l_tax) AS ct, ROUND(stddev(l_quantity), 6) AS sd, ROUND(variance(l_quantity), 6) AS vr, count(DISTINCT l_suppkey) AS cd, sum(DISTINCT l_quantity) AS sd2, ROUND(avg(DISTINCT l_quantity), 6) AS ad, ROUND(stddev(DISTINCT l_quantity), 6) AS sdd, ROUND(variance(DISTINCT l_quantity), 6) AS vd, median(l_quantity) AS md FROM lineitem GROUP BY l_returnflag",) * 2,
    "join_inner": "SELECT c.c_custkey, n.n_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 400000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 450000",
    "join_right": "SELECT o.o_orderkey, c.c_name FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000",
    "join_full": "SELECT a.r_name AS ra, b.n_name AS nb FROM region a FULL JOIN nation b ON a.r_regionkey = b.n_nationkey",
    "join_cross": "SELECT a.r_name AS ra, b.r_name AS rb FROM region a CROSS JOIN region b",
    "join_comma": "SELECT a.r_name AS ra, n.n_name AS nb FROM region a, nation n WHERE a.r_regionkey = n.n_regionkey",
    "join_using": "WITH x AS (SELECT c_custkey AS k, c_name FROM customer), y AS (SELECT o_custkey AS k, o_orderkey FROM orders) SELECT k, c_name, o_orderkey FROM x LEFT JOIN y USING (k)",
    "join_natural": "WITH x (k, a) AS (SELECT n_regionkey, n_name FROM nation), y (k, b) AS (SELECT r_regionkey, r_name FROM region) SELECT k, a, b FROM x NATURAL JOIN y",
    "join_theta": "SELECT a.n_name AS na, b.n_name AS nb FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT a.c_custkey AS ca, b.c_custkey AS cb FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1",
    "join_semi": "SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey",
    "set_union": "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_ordered": "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders ORDER BY k DESC LIMIT 7",
    "cte_nested": "WITH a (k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey AS nk, ROUND(sum(total), 2) AS total, count(*) AS n FROM a JOIN customer ON k = c_custkey GROUP BY c_nationkey) SELECT n_name, total, n FROM b JOIN nation ON nk = n_nationkey",
}
SQL["join_semi"] = (SQL["join_semi"], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
SQL["casts"] = tuple(SQL["casts"])

_PATH = "SELECT md5(o.o_custkey::VARCHAR) AS {u}, l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
ORACLE: dict[str, str] = {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()}
ORACLE |= {
    "values_join": "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "set_union_by_name": "SELECT DISTINCT c_custkey AS k, c_nationkey AS n FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier",
    "l1_norms": "SELECT o_custkey, ROUND(sum(abs(s)), 2) AS norm FROM (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY ALL) GROUP BY 1",
    "l2_norms": "SELECT o_custkey, ROUND(sqrt(sum(s * s)), 2) AS norm FROM (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY ALL) GROUP BY 1",
    "l2_clipped_sums": "WITH s AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY ALL), f AS (SELECT *, s / greatest(1.0, sqrt(sum(s * s) OVER (PARTITION BY o_custkey)) / 300000.0) AS c FROM s) SELECT o_orderpriority, ROUND(sum(c), 2) AS total FROM f GROUP BY 1",
    "limit_contributions": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR)) AS r FROM orders) WHERE r <= 2",
    "public_values_cross": "SELECT f AS l_returnflag, s AS l_linestatus FROM (VALUES ('A'), ('N'), ('R')) x(f), (VALUES ('F'), ('O')) y(s)",
    "distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_quantity) AS quantities FROM lineitem GROUP BY 1",
    "filter_columns": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12 AND l_returnflag IN ('A', 'R')",
    "pup_table": "SELECT md5(o_custkey::VARCHAR) AS unit, o_orderkey FROM orders",
    "pup_path": "SELECT md5(o.o_custkey::VARCHAR) AS unit, l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "pup_map": "SELECT md5(o_custkey::VARCHAR) AS unit, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000",
    "pup_reduce": "SELECT md5(o_custkey::VARCHAR) AS unit, o_orderstatus, count(*) AS n, ROUND(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS weight FROM orders GROUP BY ALL",
    "pup_join": "SELECT md5(c_custkey::VARCHAR) AS unit, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "pup_row": "SELECT count(*) AS n, count(*) AS units FROM events",
    "dp_exact_distinct": "SELECT l_returnflag, count(DISTINCT l_quantity) AS n, sum(DISTINCT l_quantity) AS total FROM lineitem GROUP BY l_returnflag",
    "dp_exact_sums": "WITH s AS (SELECT o_custkey, o_orderpriority AS p, sum(o_totalprice) AS s, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), f AS (SELECT p, s / greatest(1.0, sqrt(sum(s * s) OVER (PARTITION BY o_custkey)) / 50000000.0) AS s, n / greatest(1.0, sqrt(sum(n * n) OVER (PARTITION BY o_custkey)) / 100.0) AS n FROM s) SELECT p AS o_orderpriority, ROUND(sum(s), 2) AS total, round(sum(n))::BIGINT AS n FROM f GROUP BY 1",
    "dp_keys_threshold_exact": f"SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > {tau(0.5, 5e-4, 5)!r}",
    "dp_keys_public": "SELECT f AS l_returnflag, s AS l_linestatus FROM (VALUES ('A'), ('N'), ('R')) x(f), (VALUES ('F'), ('O')) y(s)",
    "rewrite_pup_sql": "SELECT md5(o.o_custkey::VARCHAR) AS unit, o.o_orderpriority, ROUND(sum(l.l_extendedprice), 2) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2",
    "synthetic_redirect": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1",
    "compose_views": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1",
    "weighted_reduce": "WITH g AS (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1), c AS (SELECT (2.0 * count(*) FILTER (WHERE n <= 1) + count(*) FILTER (WHERE n > 1)) / count(*) AS c FROM g) SELECT o_orderpriority, ROUND(n * c * 4, 4) AS n, ROUND(s * 4, 2) AS total FROM g, c",
    "weighted_join": "SELECT ROUND(count(*) * 4.0::DOUBLE, 4) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0",
    "span_of_sql_round_trip": "SELECT o_orderstatus, count(*) AS n, ROUND(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
}


def _unit(df):
    return df.withColumnRenamed(UNIT, "unit")


def _silent(sigma):
    return F.lit(0.0)


def _rewrite(c, text, parameters, draw=None, unit=UNITS):
    return rewrite_with_dp(c.sql(text), unit, c.tables, parameters, draw=draw)


HALF = Parameters(1.0, 1e-3)


def values_join(spark, d):
    c = catalog(spark, d)
    urgent = values("p", list(PRIORITIES[:2]))
    r = join(urgent, c["orders"], fn("eq", col("p"), col("o_orderpriority")))
    return r.group_by("p", n=agg("count")).dataframe(spark)


def set_union_by_name(spark, d):
    c = catalog(spark, d)
    a = c["customer"].select(k=col("c_custkey"), n=col("c_nationkey"))
    return set_op("union", a, c["supplier"].select(n=col("s_nationkey"), k=col("s_suppkey")), by_name=True).dataframe(spark)


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def l1_norms(spark, d):
    return t.l1_norms(_orders(spark, d), "o_custkey", ["o_orderpriority"], ["o_totalprice"]).select("o_custkey", F.round("o_totalprice", 2).alias("norm"))


def l2_norms(spark, d):
    return t.l2_norms(_orders(spark, d), "o_custkey", ["o_orderpriority"], ["o_totalprice"]).select("o_custkey", F.round("o_totalprice", 2).alias("norm"))


def l2_clipped_sums(spark, d):
    return t.l2_clipped_sums(_orders(spark, d), "o_custkey", ["o_orderpriority"], {"o_totalprice": 300000.0}).select("o_orderpriority", F.round("o_totalprice", 2).alias("total"))


def limit_contributions(spark, d):
    return t.limit_contributions(_orders(spark, d), "o_custkey", 2, F.md5(F.col("o_orderkey").cast("string"))).select("o_custkey", "o_orderkey")


def public_values_cross(spark, d):
    return t.public_values(spark, {k: DECLARED["lineitem"][k] for k in ("l_returnflag", "l_linestatus")})


def distinct_aggregates(spark, d):
    return t.distinct_aggregates(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], {"suppliers": ("count", "l_suppkey"), "quantities": ("sum", "l_quantity")})


def filter_columns(spark, d):
    return t.filter_columns(spark.read.parquet(f"{d}/lineitem.parquet"), {"l_quantity": (10, 12, None), "l_returnflag": (None, None, ["A", "R"])}).select("l_orderkey", "l_linenumber")


def poisson_sample(spark, d):
    return t.poisson_sampling(spark.read.parquet(f"{d}/lineitem.parquet"), 0.1, 3)


def sample_without_replacement(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.sampling_without_replacement(li, 0.01, li.count(), seed=3)


def _tracked(spark, d, text, unit=UNITS):
    c = catalog(spark, d)
    return rewrite_as_tracked(c.sql(text), unit, c.tables).relation.dataframe(spark)


def pup_table(spark, d):
    return _unit(_tracked(spark, d, "SELECT o_orderkey FROM orders")).select("unit", "o_orderkey")


def pup_path(spark, d):
    return _unit(_tracked(spark, d, "SELECT l_orderkey, l_linenumber FROM lineitem")).select("unit", "l_orderkey", "l_linenumber")


def pup_map(spark, d):
    return _unit(_tracked(spark, d, "SELECT o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000")).select("unit", "twice")


def pup_reduce(spark, d):
    out = _unit(_tracked(spark, d, "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus"))
    return out.select("unit", "o_orderstatus", "n", F.round("total", 2).alias("total"), F.col("_PRIVACY_UNIT_WEIGHT_").alias("weight"))


def pup_join(spark, d):
    return _unit(_tracked(spark, d, "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")).select("unit", "c_name", "o_orderkey")


def pup_row(spark, d):
    out = _unit(_tracked(spark, d, "SELECT event_id FROM events", PrivacyUnit.of({"events": ([], ROW)})))
    return out.agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"))


def dp_exact_sums(spark, d):
    c = catalog(spark, d)
    out = _rewrite(c, "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_orderpriority", HALF, _silent).relation.dataframe(spark)
    return out.select("o_orderpriority", F.round("total", 2).alias("total"), "n")


def dp_exact_distinct(spark, d):
    c = catalog(spark, d)
    return _rewrite(c, "SELECT l_returnflag, count(DISTINCT l_quantity) AS n, sum(DISTINCT l_quantity) AS total FROM lineitem GROUP BY l_returnflag", HALF, _silent).relation.dataframe(spark)


def dp_keys_threshold_exact(spark, d):
    c = catalog(spark, d)
    return _rewrite(c, "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey", HALF, _silent).relation.dataframe(spark)


def dp_keys_public(spark, d):
    c = catalog(spark, d)
    return _rewrite(c, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", HALF).relation.dataframe(spark).select("l_returnflag", "l_linestatus")


def _noisy(text):
    def run(spark, d):
        return _rewrite(catalog(spark, d), text, HALF).relation.dataframe(spark)

    return run


def rewrite_pup_sql(spark, d):
    out = _unit(_tracked(spark, d, "SELECT o_orderpriority, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"))
    return out.select("unit", "o_orderpriority", F.round("total", 2).alias("total"))


def synthetic_redirect(spark, d):
    c = catalog(spark, d)
    c.redirect("orders", _orders(spark, d).where("o_orderkey % 2 = 0"))
    r = c.sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    return rewrite_with_dp(r, UNITS, c.tables, None, c.synthetic).relation.dataframe(spark)


def compose_views(spark, d):
    c = catalog(spark, d)
    view = c.sql("SELECT * FROM orders WHERE o_totalprice > 250000")
    return c.sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus").compose({"orders": view}).dataframe(spark)


def _quarter(spark, d):
    c = catalog(spark, d)
    c.add("orders", _orders(spark, d).where("o_orderkey % 4 = 0"), DECLARED["orders"], {"o_orderkey"})
    return c


def weighted_reduce(spark, d):
    r = _quarter(spark, d).sql("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority")
    return sampling.adjusted(r, spark, 4.0).df.select("o_orderpriority", F.round("n", 4).alias("n"), F.round("total", 2).alias("total"))


def weighted_join(spark, d):
    r = _quarter(spark, d).sql("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
    return sampling.adjusted(r, spark, {"orders": 4.0}).df.select(F.round("n", 4).alias("n"))


def span_of_sql_round_trip(spark, d):
    """A plan printed as SQL and run by Spark gives what the plan gives."""
    from .plans.dialects import query

    c = catalog(spark, d)
    r = c.sql("SELECT o_orderstatus, count(*) AS n, ROUND(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
    _orders(spark, d).createOrReplaceTempView("orders")
    return spark.sql(query(r, "spark"))


def _text(name):
    def run(spark, d):
        return catalog(spark, d).run(spark, SQL[name] if isinstance(SQL[name], str) else SQL[name][0])

    return run


def flagship(spark, d):
    """Noisy revenue by order priority; customers are protected."""
    return _noisy("SELECT o_orderpriority, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY o_orderpriority")(spark, d)


QUERIES = {name: _text(name) for name in SQL}
QUERIES |= {f.__name__: f for f in (values_join, set_union_by_name, l1_norms, l2_norms, l2_clipped_sums, limit_contributions, public_values_cross, distinct_aggregates, filter_columns, poisson_sample, sample_without_replacement, pup_table, pup_path, pup_map, pup_reduce, pup_join, pup_row, dp_exact_sums, dp_exact_distinct, dp_keys_threshold_exact, dp_keys_public, rewrite_pup_sql, synthetic_redirect, compose_views, weighted_reduce, weighted_join, span_of_sql_round_trip, flagship)}
QUERIES |= {
    "dp_sum": _noisy("SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority"),
    "dp_count": _noisy("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "dp_mean": _noisy("SELECT o_orderstatus, avg(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus"),
    "dp_var": _noisy("SELECT l_returnflag, variance(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"),
    "dp_std": _noisy("SELECT l_returnflag, stddev(l_quantity) AS s FROM lineitem GROUP BY l_returnflag"),
    "dp_count_distinct": _noisy("SELECT l_returnflag, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY l_returnflag"),
    "dp_keys_private": _noisy("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    "dp_keys_mixed": _noisy("SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_suppkey"),
    "rewrite_dp_sql": _noisy("SELECT o_orderpriority, ROUND(sum(l_extendedprice) / 1000, 2) AS thousands FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05 GROUP BY o_orderpriority"),
}

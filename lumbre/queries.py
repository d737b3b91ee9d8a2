"""Queries over the driver's tables, one per operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre import operators as O
from lumbre.functions import arrays as A
from lumbre.functions import calendar, finance, statistics
from lumbre.functions.user import Program as Functions
from lumbre.operators.aggregate import Metric
from lumbre.plans.parser import parse
from lumbre.sources import reports, staging
from lumbre.streaming import bounded, events
from lumbre.types import Schema, as_text, binary_state, risk_name, safe_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


M = Metric
BASIC = lambda c: [M("suma", c, name="suma"), M("media", c, name="media"), M("minimo", c, name="minimo"), M("maximo", c, name="maximo"), M("conteo", c, name="conteo")]
BASIC_SQL = lambda c: f"round(sum({c}), 4) AS suma, round(avg({c}), 4) AS media, min({c}) AS minimo, max({c}) AS maximo, count({c}) AS conteo"


def signed_round(c: Column, n: int) -> Column:
    """A double to n places; what rounds to zero keeps its sign, as in IEEE and in the SQL, and unlike F.round."""
    return F.abs(F.round(c, n)) * F.signum(c)


def rounded(df: DataFrame, *names: str, n: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: signed_round(F.col(c), n) if kinds[c] == "double" else F.round(F.col(c), n) for c in names})


# The flagship: scan, derive, filter, group, sort.


@query(f"""
SELECT l_returnflag, {BASIC_SQL('total')} FROM (SELECT l_returnflag, l_extendedprice * l_quantity AS total FROM lineitem WHERE l_quantity > 10)
GROUP BY l_returnflag ORDER BY l_returnflag""")
def flagship(spark, d):
    t = O.add_product(O.filter_number(table(spark, d, "lineitem"), "l_quantity", ">", 10), "l_extendedprice", "l_quantity")
    return rounded(O.sort(O.grouped(t, ["l_returnflag"], BASIC("total")), [("l_returnflag", False)]), "suma", "media")


# Projections, filters, cleaning, reshaping.


@query("SELECT n_name, n_regionkey FROM nation")
def select_columns(spark, d):
    return O.select(table(spark, d, "nation"), ["n_name", "n_regionkey"])


def _filter(name: str, op: str, value: float, sql_op: str):
    def f(spark, d):
        return O.filter_number(table(spark, d, "lineitem"), "l_quantity", op, value).select("l_orderkey", "l_linenumber", "l_quantity")

    f.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {sql_op} {value}")(f)


for _name, _op, _sql in (("filter_gt", ">", ">"), ("filter_ge", ">=", ">="), ("filter_lt", "<", "<"), ("filter_le", "<=", "<="), ("filter_eq", "==", "="), ("filter_ne", "!=", "<>")):
    _filter(_name, _op, 25, _sql)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 3) <> 2")
def filter_null_not_equal(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"), "l_linenumber")
    return O.filter_number(t, "n", "!=", 2).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000.5")
def filter_exact_integer(spark, d):
    return O.filter_number(table(spark, d, "orders"), "o_orderkey", ">", 1000.5).select("o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def filter_text_eq(spark, d):
    return O.filter_text(table(spark, d, "events"), "event_type", "click").select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 7 = 0")
def filter_by_mask(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return O.filter_mask(t.drop("o_custkey"), t.select("o_orderkey", (F.col("o_custkey") % 7 == 0).alias("flag")), "o_orderkey", "flag")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal * c_nationkey > 0")
def filter_positive_product(spark, d):
    return O.filter_positive_product(table(spark, d, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity, 4) AS total FROM lineitem")
def derive_product(spark, d):
    return rounded(O.add_product(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "total"), "total")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS periodo FROM orders")
def derive_month(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"))
    return O.add_month(t).select("o_orderkey", "periodo")


@query("SELECT l_orderkey, l_linenumber, nullif(l_quantity, 5) AS q FROM lineitem WHERE nullif(l_quantity, 5) IS NOT NULL")
def drop_nulls(spark, d):
    return O.drop_nulls(_with_nulls(spark, d), ["q"])


def _with_nulls(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(5.0)).alias("q"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_quantity, 5), 0.5) AS q FROM lineitem")
def fill_null(spark, d):
    return O.fill_null(_with_nulls(spark, d), "q", 0.5)


@query("SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(nullif(l_quantity, 5)) FROM lineitem)), 4) AS q FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 5) AS q FROM lineitem)")
def impute_mean(spark, d):
    return rounded(O.impute_mean(_with_nulls(spark, d), ["q"]), "q")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def drop_duplicates(spark, d):
    return O.drop_duplicates(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def keep_first_duplicate(spark, d):
    return O.keep_first(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot(spark, d):
    return O.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("SELECT c_custkey, c_mktsegment, c_mktsegment || '-' || c_nationkey AS etiqueta FROM customer")
def add_column(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return O.add_column(t, "etiqueta", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))).drop("c_nationkey")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def typed_columns(spark, d):
    t = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return Schema().declare("k", "numerica").apply(t.select(F.col("event_id").cast("string").alias("event_id"), "k")).select(F.col("event_id").cast("long").alias("event_id"), "k")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size > 25 THEN 'verdadero' ELSE 'falso' END AS grande FROM part")
def table_as_text(spark, d):
    return as_text(table(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).alias("grande")))


# Joins of whole tables. Some keys are changed, so that rows without a partner and null keys stand on both sides.


def _sides(spark, d):
    left = table(spark, d, "customer").select(F.expr("if(c_custkey % 3 = 0, -c_custkey, c_custkey)").alias("c_custkey"), "c_nationkey")
    right = table(spark, d, "orders").select(F.expr("if(o_custkey % 4 = 0, null, o_custkey)").alias("c_custkey"), "o_orderkey")
    return left, right


LEFT_SQL = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_nationkey FROM customer)"
RIGHT_SQL = "(SELECT CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS c_custkey, o_orderkey FROM orders)"
SIDES_SQL = f"{LEFT_SQL} l {{how}} JOIN {RIGHT_SQL} r ON l.c_custkey = r.c_custkey"


def _join(how: str):
    def f(spark, d):
        return O.join(*_sides(spark, d), ["c_custkey"], how=how)

    f.__name__ = f"join_{how}"
    query(f"SELECT l.c_custkey, c_nationkey, r.c_custkey AS c_custkey_right, o_orderkey FROM {SIDES_SQL.format(how=how.upper())}")(f)


for _how in ("inner", "left", "right", "full"):
    _join(_how)


@query(f"SELECT DISTINCT l.c_custkey, c_nationkey FROM {SIDES_SQL.format(how='')}")
def join_semi(spark, d):
    return O.join(*_sides(spark, d), ["c_custkey"], how="semi")


@query(f"SELECT c_custkey, c_nationkey FROM {LEFT_SQL} l WHERE NOT EXISTS (SELECT 1 FROM {RIGHT_SQL} r WHERE r.c_custkey = l.c_custkey)")
def join_anti(spark, d):
    return O.join(*_sides(spark, d), ["c_custkey"], how="anti")


@query("SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def join_multi_key(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), "o_custkey")
    return O.join(left, right, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def join_with_limit(spark, d):
    return O.join(table(spark, d, "nation"), table(spark, d, "supplier"), ["n_nationkey"], ["s_nationkey"], max_rows=10_000_000).select("n_name", "s_suppkey")


@query("SELECT 'inner' AS how, count(*) AS filas FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left_anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_preflight(spark, d):
    """How many rows joins would have, without forming them."""
    left, right = table(spark, d, "customer"), table(spark, d, "orders")
    return spark.createDataFrame([(how, O.join_size(left, right, ["c_custkey"], ["o_custkey"], how)[0]) for how in ("inner", "full", "left_anti")], "how string, filas long")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return O.cross_join(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return O.theta_join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 1")
def join_band(spark, d):
    return O.band_join(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "customer").select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 1.0).select("s_suppkey", "c_custkey")


@query("""SELECT event_id, (SELECT max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS o_orderkey
FROM events WHERE event_type = 'purchase'""")
def join_as_of(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return O.as_of_join(e, o, ["k"], "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


# Aggregates.


@query(f"SELECT l_returnflag, {BASIC_SQL('l_quantity')} FROM lineitem GROUP BY l_returnflag")
def group_basic(spark, d):
    return rounded(O.grouped(table(spark, d, "lineitem"), ["l_returnflag"], BASIC("l_quantity")), "suma", "media")


@query(f"SELECT l_returnflag, l_linestatus, {BASIC_SQL('l_extendedprice')} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi_key(spark, d):
    return rounded(O.grouped(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], BASIC("l_extendedprice")), "suma", "media")


@query(f"SELECT nullif(l_linenumber, 2) AS k, {BASIC_SQL('q')} FROM (SELECT l_linenumber, nullif(l_quantity, 5) AS q FROM lineitem) GROUP BY 1")
def group_null_key(spark, d):
    t = table(spark, d, "lineitem").select(F.nullif("l_linenumber", F.lit(2)).alias("k"), F.nullif("l_quantity", F.lit(5.0)).alias("q"))
    return rounded(O.grouped(t, ["k"], BASIC("q")), "suma", "media")


@query("SELECT l_suppkey % 1000 AS grupo, round(sum(l_quantity), 4) AS suma FROM lineitem GROUP BY 1")
def group_thousand_keys(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 1000).alias("grupo"), "l_quantity")
    return rounded(O.grouped(t, ["grupo"], [M("suma", "l_quantity", name="suma")]), "suma")


@query("SELECT event_type AS k, round(sum(value), 4) AS suma FROM events GROUP BY event_type")
def group_spill(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("k"), "value")
    return rounded(O.grouped_spill(t, "k", M("suma", "value", name="suma")), "suma")


@query("SELECT o_orderpriority, count(o_orderkey) AS conteo FROM orders GROUP BY o_orderpriority")
def group_first_seen(spark, d):
    return O.grouped(table(spark, d, "orders"), ["o_orderpriority"], [M("conteo", "o_orderkey", name="conteo")], first_seen="o_orderkey")


SUMMARY_SQL = "round(var_pop(l_quantity), 4) AS varianza, round(stddev_pop(l_quantity), 4) AS desviacion, median(l_quantity) AS mediana, round(quantile_cont(l_quantity, 0.9), 4) AS p90"


@query(f"SELECT {BASIC_SQL('l_quantity')}, {SUMMARY_SQL} FROM lineitem")
def summary_all(spark, d):
    c = "l_quantity"
    return rounded(O.summary(table(spark, d, "lineitem"), [M("varianza", c, name="varianza"), M("desviacion_estandar", c, name="desviacion"), M("mediana", c, name="mediana"), M("percentil", c, 90, "p90"), *BASIC(c)]), "suma", "media", "varianza", "desviacion", "p90")


@query(f"SELECT l_returnflag, {SUMMARY_SQL} FROM lineitem GROUP BY l_returnflag")
def group_advanced(spark, d):
    c = "l_quantity"
    return rounded(O.grouped(table(spark, d, "lineitem"), ["l_returnflag"], [M("varianza", c, name="varianza"), M("desviacion_estandar", c, name="desviacion"), M("mediana", c, name="mediana"), M("percentil", c, 90, "p90")]), "varianza", "desviacion", "p90")


@query("""SELECT p, round(value, 4) AS value FROM (SELECT CAST(50 AS DOUBLE) AS p, quantile_cont(l_extendedprice, 0.5) AS value FROM lineitem
UNION ALL SELECT 90, quantile_cont(l_extendedprice, 0.9) FROM lineitem UNION ALL SELECT 99.9, quantile_cont(l_extendedprice, 0.999) FROM lineitem)""")
def percentiles_exact(spark, d):
    return rounded(O.exact_percentiles(table(spark, d, "lineitem"), "l_extendedprice", [50, 90, 99.9], few=500), "value")


@query("SELECT CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS suma FROM lineitem")
def sum_boolean(spark, d):
    return O.summary(table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("b")), [M("suma", "b", name="suma")])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS suma, grouping(l_returnflag, l_linestatus) AS grouping_id FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return rounded(O.rollup(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [M("suma", "l_quantity", name="suma")]), "suma")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS suma, grouping(l_returnflag, l_linestatus) AS grouping_id FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return rounded(O.cube(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [M("suma", "l_quantity", name="suma")]), "suma")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS suma, grouping(l_returnflag, l_linestatus) AS grouping_id FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, d):
    return rounded(O.grouping_sets(table(spark, d, "lineitem"), [["l_returnflag"], ["l_linestatus"]], ["l_returnflag", "l_linestatus"], [M("suma", "l_quantity", name="suma")]), "suma")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS \"distinct\" FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, d):
    return O.distinct_counts(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey")


@query("SELECT l_returnflag, true AS dentro FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark, d):
    """Whether each sketch is within five standard errors of the exact count."""
    t = table(spark, d, "lineitem")
    exact = O.distinct_counts(t, ["l_returnflag"], "l_partkey").select("l_returnflag", F.col("distinct").alias("exact"))
    return O.approximate_distinct(t, ["l_returnflag"], "l_partkey").join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("distinct") - F.col("exact")) <= 0.1 * F.col("exact")).alias("dentro"))


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 4) AS "F", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 4) AS "O"
FROM lineitem GROUP BY l_returnflag""")
def pivot(spark, d):
    return rounded(O.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], M("suma", "l_quantity")), "F", "O")


@query("""SELECT l_returnflag, count(l_quantity) AS conteo, round(sum(l_quantity), 4) AS suma, round(avg(l_quantity), 4) AS media, min(l_quantity) AS minimo, max(l_quantity) AS maximo,
round(var_pop(l_quantity), 4) AS varianza, round(var_samp(l_quantity), 4) AS varianza_muestral FROM lineitem GROUP BY l_returnflag""")
def merged_states(spark, d):
    daily = O.partial_state(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity")
    out = O.final_state(O.merge_states(daily.drop("l_linenumber"), ["l_returnflag"]), ["l_returnflag"]).drop("nulos", "invalidos", "suma_exacta")
    return rounded(out, "suma", "media", "varianza", "varianza_muestral")


@query("""SELECT l_returnflag, count(v) AS conteo, count(*) - count(v) AS nulos, CAST(0 AS BIGINT) AS invalidos, CAST(sum(CAST(v AS HUGEINT)) AS VARCHAR) AS suma_exacta
FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 3 THEN l_orderkey * 1000003 + 4611686018427387904 END AS v FROM lineitem) GROUP BY l_returnflag""")
def merged_states_exact(spark, d):
    """Sums beyond 64 bits, through the text form of the states."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_orderkey").cast("long") * 1000003 + 4611686018427387904).alias("v"))
    stored = O.encode_states(O.partial_state(t, ["l_returnflag", "l_linenumber"], "v"))
    out = O.final_state(O.merge_states(O.decode_states(stored).drop("l_linenumber"), ["l_returnflag"]), ["l_returnflag"])
    return out.select("l_returnflag", "conteo", "nulos", "invalidos", F.col("suma_exacta").cast("string").alias("suma_exacta"))


@query("""SELECT event_type, count(TRY_CAST(k AS DOUBLE)) AS conteo, count_if(k = '') AS nulos, count_if(k <> '' AND TRY_CAST(k AS DOUBLE) IS NULL) AS invalidos FROM """ + "(SELECT CASE WHEN event_id % 9 = 0 THEN 'no-num' WHEN event_id % 11 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k, event_type FROM events) GROUP BY event_type")
def merged_states_text(spark, d):
    return O.final_state(O.merge_states(O.partial_state(_dirty(spark, d), ["event_type", "u"], "k", is_text=True).drop("u"), ["event_type"]), ["event_type"]).select("event_type", "conteo", "nulos", "invalidos")


# Windows, order, sets.


@query("""SELECT o_orderkey, row_number() OVER w AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 4) AS percent_rank,
round(cume_dist() OVER w, 4) AS cume_dist, ntile(4) OVER w AS ntile FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""")
def window_rank(spark, d):
    out = O.ranked(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist"], 4)
    out = out.select("o_orderkey", *(F.col(c).cast("long").alias(c) for c in ("row_number", "rank", "dense_rank", "ntile")), "percent_rank", "cume_dist")
    return rounded(out, "percent_rank", "cume_dist")


@query("SELECT event_id, lag(value) OVER w AS lag, lead(value) OVER w AS lead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lag(spark, d):
    return O.lagged(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", "lag", "lead")


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS running_sum, round(avg(value) OVER w, 10) AS running_avg, first(value) OVER w AS first_value, last(value) OVER w AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def window_running(spark, d):
    out = O.cumulative(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return rounded(rounded(out.select("event_id", "running_sum", "running_avg", "first_value", "last_value"), "running_sum"), "running_avg", n=10)


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS running_sum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def window_moving(spark, d):
    return rounded(O.cumulative(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value", 3).select("event_id", "running_sum"), "running_sum")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS inicio, event_type, count(*) AS n, round(sum(value), 4) AS suma FROM events GROUP BY 1, 2""")
def window_tumbling(spark, d):
    out = O.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("suma"))
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "event_type", "n", "suma"), "suma")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM (
SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1""")
def window_sliding(spark, d):
    out = O.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "n")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def window_session(spark, d):
    out = O.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "n")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(spark, d):
    return O.sort(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, nullif(l_quantity, 5) AS q FROM lineitem ORDER BY q DESC NULLS LAST")
def sort_nulls_last(spark, d):
    return O.sort(_with_nulls(spark, d), [("q", True)])


@query("SELECT o_totalprice FROM orders UNION ALL SELECT c_acctbal FROM customer ORDER BY 1")
def merge_sorted(spark, d):
    return O.merge_sorted([table(spark, d, "orders").select("o_totalprice"), table(spark, d, "customer").select(F.col("c_acctbal").alias("o_totalprice"))], "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return O.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return O.head(O.sort(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_orderkey", False)]), 10, 5)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def topk_per_group(spark, d):
    return O.top_k(table(spark, d, "orders"), [("o_totalprice", True), ("o_orderkey", False)], 2, ["o_custkey"]).select("o_custkey", "o_orderkey")


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


for _name, _op, _sql in (("union_all", O.union_all, "UNION ALL"), ("union_distinct", O.union_distinct, "UNION"), ("intersect_distinct", O.intersect_distinct, "INTERSECT"), ("intersect_all", O.intersect_all, "INTERSECT ALL"), ("except_distinct", lambda a, b: O.except_distinct(a, b.filter("k > 10")), "EXCEPT"), ("except_all", O.except_all, "EXCEPT ALL")):

    def _set(spark, d, op=_op):
        return op(*_keys(spark, d))

    _set.__name__ = _name
    query(f"SELECT c_nationkey AS k FROM customer {_sql} SELECT s_nationkey AS k FROM supplier" + (" WHERE s_nationkey > 10" if _name == "except_distinct" else ""))(_set)


# Bounded streams and their accounting. Every ninth text is no number, every eleventh is blank.

DIRTY_SQL = "(SELECT CASE WHEN event_id % 9 = 0 THEN 'no-num' WHEN event_id % 11 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k, event_type, CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id % 20 AS VARCHAR) END AS u FROM events)"


def _dirty(spark, d):
    return table(spark, d, "events").select(
        F.when(F.col("event_id") % 9 == 0, "no-num").when(F.col("event_id") % 11 == 0, "").otherwise(F.get_json_object("props", "$.k")).alias("k"), "event_type", F.when(F.col("user_id") % 5 == 0, "").otherwise((F.col("user_id") % 20).cast("string")).alias("u")
    )


@query(f"""SELECT count(*) AS filas, count(x) AS filas_validas, sum(x) AS suma, round(avg(x), 4) AS media, min(x) AS minimo, max(x) AS maximo, CAST(count(x) AS DOUBLE) AS conteo,
round(coalesce(var_samp(x), 0), 4) AS varianza, round(coalesce(stddev_samp(x), 0), 4) AS desviacion, count(*) - count(x) AS invalidos FROM (SELECT TRY_CAST(k AS DOUBLE) AS x FROM {DIRTY_SQL})""")
def stream_summary(spark, d):
    ops = ["suma", "media", "minimo", "maximo", "conteo", "varianza", "desviacion_estandar"]
    out = bounded.summary(_dirty(spark, d), [(o, "k") for o in ops])
    out = out.select("filas", "filas_validas", *(F.col(f"v{i}").alias(o.removesuffix("_estandar")) for i, o in enumerate(ops)), F.col("i0").alias("invalidos"))
    return rounded(out, "media", "varianza", "desviacion")


@query(f"SELECT count(*) AS filas, round(sum(TRY_CAST(k AS DOUBLE)), 4) AS suma FROM {DIRTY_SQL} WHERE event_type = 'click'")
def stream_filter_text(spark, d):
    return bounded.summary(bounded.filtered(_dirty(spark, d), ("event_type", "==", "click")), [("suma", "k")]).select("filas", signed_round(F.col("v0"), 4).alias("suma"))


@query(f"SELECT count(*) AS filas, round(sum(TRY_CAST(k AS DOUBLE)), 4) AS suma FROM {DIRTY_SQL} WHERE TRY_CAST(k AS DOUBLE) > 40")
def stream_filter_number(spark, d):
    return bounded.summary(bounded.filtered(_dirty(spark, d), ("k", ">", 40)), [("suma", "k")]).select("filas", signed_round(F.col("v0"), 4).alias("suma"))


@query(f"""SELECT u, count(*) AS filas, sum(TRY_CAST(k AS DOUBLE)) AS suma, count(TRY_CAST(k AS DOUBLE)) AS validos, count_if(k = '') AS nulos, count_if(k <> '' AND TRY_CAST(k AS DOUBLE) IS NULL) AS invalidos,
CAST(count_if(k <> '') AS DOUBLE) AS conteo, round(CASE WHEN count(TRY_CAST(k AS DOUBLE)) = 1 THEN 0 ELSE var_samp(TRY_CAST(k AS DOUBLE)) END, 4) AS varianza FROM {DIRTY_SQL} GROUP BY u""")
def stream_grouped(spark, d):
    out = bounded.grouped(_dirty(spark, d), ["u"], [("suma", "k"), ("conteo", "k"), ("varianza", "k")])
    return rounded(out.select("u", "filas", F.col("v0").alias("suma"), F.col("n0").alias("validos"), F.col("u0").alias("nulos"), F.col("i0").alias("invalidos"), F.col("v1").alias("conteo"), F.col("v2").alias("varianza")), "varianza")


@query(f"SELECT nullif(u, '') AS u, event_type, sum(TRY_CAST(k AS DOUBLE)) AS suma, max(TRY_CAST(k AS DOUBLE)) AS maximo FROM {DIRTY_SQL} GROUP BY 1, 2")
def stream_two_keys(spark, d):
    out = bounded.grouped(_dirty(spark, d), ["u", "event_type"], [("suma", "k"), ("maximo", "k")])
    return out.select("u", "event_type", F.col("v0").alias("suma"), F.col("v1").alias("maximo"))


@query(f"SELECT count_if(TRY_CAST(k AS DOUBLE) IS NOT NULL) AS validos, count_if(TRY_CAST(k AS DOUBLE) IS NULL AND k <> '') AS invalidos, count_if(k = '') AS nulos FROM {DIRTY_SQL}")
def valid_invalid_counts(spark, d):
    k = F.col("k")
    return _dirty(spark, d).agg(F.count(safe_number(k)).alias("validos"), F.count_if(safe_number(k).isNull() & (k != "")).alias("invalidos"), F.count_if(k == "").alias("nulos"))


@query("SELECT sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS valor FROM events")
def single_sum(spark, d):
    return bounded.single_sum_or_count(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")), "k", "suma")


# Event time. The stream reads the same Parquet file; complete mode gives the batch result.


def _streamed(df, name, mode):
    return events.run_available(df, staging.fresh(df.sparkSession, f"stream-{name}"), mode)


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    at = f"{d}/events.parquet"
    raw = reader.parquet(at) if _is_folder(spark, at) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS inicio, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_tumbling(spark, d):
    out = events.windowed(_event_stream(spark, d), "ts", "10 minutes", "1 hour", None, ["event_type"], F.count(F.lit(1)).alias("n"))
    return _streamed(out, "tumbling", "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS suma FROM events GROUP BY event_type")
def streaming_summary(spark, d):
    out = _event_stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("suma"))
    return rounded(_streamed(out, "summary", "complete"), "suma")


@query("SELECT event_id, user_id FROM events")
def streaming_dedup(spark, d):
    return _streamed(events.deduplicated(_event_stream(spark, d), "ts", "1 day", ["event_id"]), "dedup", "append").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def streaming_state(spark, d):
    out = _streamed(events.running_totals(_event_stream(spark, d).select("event_type", "value"), "event_type", "value"), "state", "update")
    return out.groupBy("event_type").agg(F.max("n").alias("n"), signed_round(F.max_by("total", "n"), 3).alias("total"))


# Profiles and statistics.


@query("SELECT 'perfil_avanzado' AS operacion, 'value' AS variable, count(value) AS n, round(avg(value), 4) AS media, round(stddev_pop(value), 4) AS desviacion, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events")
def profile_advanced(spark, d):
    return rounded(statistics.advanced_profile(table(spark, d, "events"), "value"), "media", "desviacion")


@query("""WITH v AS (SELECT l_quantity AS v, sum(l_tax) AS w FROM lineitem WHERE l_tax > 0 GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS cum, sum(w) OVER () AS t FROM v)
SELECT min(v) FILTER (cum >= 0.9 * t) AS p90, min(v) FILTER (cum >= 0.95 * t) AS p95 FROM c""")
def profile_weighted(spark, d):
    return statistics.weighted_percentiles(table(spark, d, "lineitem"), "l_quantity", "l_tax")


@query("""WITH m AS (SELECT count(value) AS n, avg(value) AS a FROM events), s AS (SELECT avg(power(value - a, 2)) AS m2, avg(power(value - a, 3)) AS m3, avg(power(value - a, 4)) AS m4 FROM events, m)
SELECT n, round(a, 4) AS media, round(m2, 4) AS varianza, round(sqrt(m2), 4) AS desviacion, round(sqrt(m2) / a, 4) AS cv, round(m3 / power(m2, 1.5), 4) AS asimetria, round(m4 / (m2 * m2) - 3, 4) AS curtosis,
(SELECT min(value) FROM events) AS minimo, (SELECT max(value) FROM events) AS maximo, round(m2 * n / (n - 1), 4) AS varianza_muestral FROM m, s""")
def moments(spark, d):
    return rounded(statistics.moments(table(spark, d, "events"), "value"), "media", "varianza", "desviacion", "cv", "asimetria", "curtosis", "varianza_muestral")


@query("""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events), b AS (SELECT least(floor((value - lo) / w), 4) AS b FROM events, e)
SELECT 'histograma' AS operacion, 'value' AS variable, [count_if(b = 0), count_if(b = 1), count_if(b = 2), count_if(b = 3), count_if(b = 4)] AS bins, CAST(0 AS BIGINT) AS bajo_minimo, CAST(0 AS BIGINT) AS sobre_maximo FROM b""")
def histogram5(spark, d):
    return statistics.histogram(table(spark, d, "events"), "value")


@query("""WITH m AS (SELECT count(value) AS n, avg(value) AS a FROM events), s AS (SELECT avg(power(value - a, 2)) AS m2, avg(power(value - a, 3)) AS m3, avg(power(value - a, 4)) AS m4 FROM events, m),
j AS (SELECT n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m, s)
SELECT 'normalidad' AS operacion, 'value' AS variable, 'jarque_bera' AS metodo, round(jb, 2) AS estadistico, round(exp(-jb / 2), 4) AS p, exp(-jb / 2) >= 0.05 AS normal, true AS aproximado FROM j""")
def normality_jb(spark, d):
    return rounded(rounded(statistics.normality(table(spark, d, "events"), "value"), "estadistico", n=2), "p")


@query("SELECT 'tasa' AS operacion, 'e' AS evento, round(sum(l_quantity), 4) AS exposicion, count_if(l_returnflag = 'R') AS incidentes, round(count_if(l_returnflag = 'R') / sum(l_quantity) * 200000, 4) AS tasa FROM lineitem")
def rate(spark, d):
    t = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "verdadero").otherwise("no").alias("e"), "l_quantity")
    return rounded(statistics.rate(t, "e", "l_quantity", 200000), "tasa", "exposicion")


@query("SELECT 'poisson' AS operacion, count_if(l_returnflag = 'R') AS eventos, round(count_if(l_returnflag = 'R') / sum(l_quantity) * 200000, 4) AS tasa FROM lineitem")
def poisson_rate(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("e"), "l_quantity")
    return rounded(statistics.poisson(t, "e", "l_quantity", 200000), "tasa").drop("ic_inferior", "ic_superior")


@query()
def poisson_interval(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("e"), "l_quantity")
    return rounded(statistics.poisson(t, "e", "l_quantity", 200000), "tasa", "ic_inferior", "ic_superior")


@query("SELECT 'correlacion' AS operacion, count(*) AS pares, round(corr(l_quantity, l_extendedprice), 6) AS coeficiente, count(*) < 30 AS muestra_pequena FROM lineitem")
def pearson(spark, d):
    return rounded(statistics.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "coeficiente", n=6)


@query("""SELECT 'wilcoxon' AS operacion, count(*) AS pares, CAST(sum(k * sign(x)) AS DOUBLE) AS estadistico FROM (
SELECT x, rank() OVER (ORDER BY abs(x)) AS k FROM (SELECT l_linenumber * 7 - l_quantity AS x FROM lineitem) WHERE x <> 0)""")
def wilcoxon(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 7).alias("b"))
    return statistics.wilcoxon(t, "a", "b").drop("p")


@query("""WITH r AS (SELECT l_returnflag = 'R' AS f, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem WHERE l_returnflag IN ('R', 'A')),
u AS (SELECT count_if(f) AS n1, count_if(NOT f) AS n2, CAST(sum(k) FILTER (f) - count_if(f) * (count_if(f) + 1) / 2.0 AS DOUBLE) AS u FROM r)
SELECT n1 AS n_first, n2 AS n_second, round(u, 1) AS u, round((u - n1 * n2 / 2) / sqrt(CAST(n1 AS DOUBLE) * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM u""")
def mann_whitney(spark, d):
    t = table(spark, d, "lineitem").filter("l_returnflag in ('R', 'A')")
    return rounded(rounded(statistics.mann_whitney(t, "l_quantity", "l_returnflag", "R").drop("p"), "u", n=1), "z", n=6)


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency(spark, d):
    return statistics.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY a), k AS (SELECT b, sum(n) AS k FROM c GROUP BY b),
e AS (SELECT r.a, k.b, r * k / (SELECT sum(n) FROM c) AS e FROM r, k)
SELECT 'chi_cuadrado' AS operacion, (SELECT count(*) FROM r) AS filas, (SELECT count(*) FROM k) AS columnas, round(sum(power(coalesce(n, 0) - e, 2) / e), 4) AS estadistico,
(SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS gl, count_if(e < 5) AS celdas_bajas FROM e LEFT JOIN c USING (a, b)""")
def chi_square(spark, d):
    return rounded(statistics.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), "estadistico")


@query("""WITH c AS (SELECT count_if(l_linestatus = 'O' AND big) AS a, count_if(l_linestatus = 'O' AND NOT big) AS b, count_if(l_linestatus <> 'O' AND big) AS c, count_if(l_linestatus <> 'O' AND NOT big) AS d FROM (SELECT l_linestatus, l_quantity > 25 AS big FROM lineitem))
SELECT 'riesgo' AS operacion, a AS eventos_expuestos, b AS no_eventos_expuestos, c AS eventos_control, d AS no_eventos_control, round((a / (a + b)) / (c / (c + d)), 6) AS riesgo_relativo, round(a * d / (b * c), 6) AS odds_ratio FROM c""")
def risk_ratio(spark, d):
    t = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_quantity") > 25, "si").otherwise("no").alias("grande"))
    return rounded(statistics.risk(t, "l_linestatus", "grande", "O", "si"), "riesgo_relativo", "odds_ratio", n=6)


@query("""WITH c AS (SELECT count_if(l_linestatus = 'O' AND big) AS a, count_if(l_linestatus = 'O' AND NOT big) AS b, count_if(l_linestatus <> 'O' AND big) AS c, count_if(l_linestatus <> 'O' AND NOT big) AS d FROM (SELECT l_linestatus, l_quantity > 25 AS big FROM lineitem)),
m AS (SELECT (a / (a + b)) / (c / (c + d)) AS rr, a * d / (b * c) AS odds, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS sr, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS so, 1.959963984540054 AS z FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM c))
SELECT round(rr, 6) AS rr, round(rr * exp(-z * sr), 5) AS rr_lower, round(rr * exp(z * sr), 5) AS rr_upper, round(odds, 6) AS odds, round(odds * exp(-z * so), 5) AS odds_lower, round(odds * exp(z * so), 5) AS odds_upper, false AS corrected FROM m""")
def risk_intervals(spark, d):
    t = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_quantity") > 25, "si").otherwise("no").alias("grande"))
    return rounded(rounded(statistics.risk_intervals(t, "l_linestatus", "grande", "O", "si"), "rr", "odds", n=6), "rr_lower", "rr_upper", "odds_lower", "odds_upper", n=5)


@query("SELECT 'modelo_sst' AS operacion, count_if(event_type <> 'view') AS eventos, 'events' AS fuente FROM events")
def event_model(spark, d):
    t = table(spark, d, "events").select(F.nullif("event_type", F.lit("view")).alias("area"), F.col("value").alias("severidad"), F.col("user_id").alias("cargo"))
    return statistics.event_model(t, "area", "severidad", "cargo", "events")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'caida' WHEN 1 THEN 'quimico' WHEN 2 THEN 'corte' ELSE 'desconocido' END AS riesgo,
CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'invalid' ELSE 'null' END AS estado FROM events""")
def labels_normalised(spark, d):
    label = F.element_at(F.array(F.lit("Caída"), F.lit("QUIMICO"), F.lit("corte"), F.lit("otro")), (F.col("event_id") % 4 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit("SI"), F.lit("quizas"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", risk_name(label).alias("riesgo"), binary_state(flag).alias("estado"))


@query("""SELECT 'k' AS columna, count(TRY_CAST(k AS DOUBLE)) AS validos, count(*) - count(TRY_CAST(k AS DOUBLE)) AS invalidos, round(avg(TRY_CAST(k AS DOUBLE)), 4) AS promedio, min(TRY_CAST(k AS DOUBLE)) AS minimo, max(TRY_CAST(k AS DOUBLE)) AS maximo FROM """ + DIRTY_SQL)
def profile_numeric(spark, d):
    return rounded(reports.numeric_profile(_dirty(spark, d), ["k"]), "promedio")


@query("SELECT c_mktsegment AS valor, count(*) AS cantidad FROM customer GROUP BY 1")
def profile_categories(spark, d):
    return reports.category_counts(table(spark, d, "customer"), "c_mktsegment")


@query("SELECT count_if(n % 3 = 1) AS ceros, count_if(n % 3 = 0) AS unos, count_if(n % 3 = 2) AS invalidos, round(count_if(n % 3 = 0) / count_if(n % 3 < 2), 6) AS tasa_unos FROM (SELECT event_id AS n FROM events)")
def profile_binary(spark, d):
    t = table(spark, d, "events").select(F.element_at(F.array(F.lit("Sí".replace("í", "i")), F.lit("FALSO"), F.lit("x")), (F.col("event_id") % 3 + 1).cast("int")).alias("b"))
    return rounded(reports.binary_profile(t, "b"), "tasa_unos", n=6)


@query("""SELECT count(*) AS filas_vistas, count_if(t > 0) AS filas_usadas, count(*) - count_if(t > 0) AS filas_rechazadas, round(sum(t) FILTER (t > 0), 2) AS total, round(avg(t) FILTER (t > 0), 4) AS promedio, round(max(t), 4) AS maxima, round(min(t) FILTER (t > 0), 4) AS minima
FROM (SELECT c_acctbal * c_nationkey AS t FROM customer)""")
def sales_report(spark, d):
    return rounded(rounded(reports.sales_summary(table(spark, d, "customer"), "c_acctbal", "c_nationkey"), "promedio", "maxima", "minima"), "total", n=2)


_FOREST_SQL = """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_tax AS x1, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
c AS (SELECT (min(x0) + max(x0)) / 2 AS c0, (min(x1) + max(x1)) / 2 AS c1 FROM t),
v AS (SELECT CASE WHEN 2 * count_if(x0 <= c0 AND y = 1) >= count_if(x0 <= c0) THEN 1 ELSE 0 END AS l0, CASE WHEN 2 * count_if(x0 > c0 AND y = 1) >= count_if(x0 > c0) THEN 1 ELSE 0 END AS h0,
CASE WHEN 2 * count_if(x1 <= c1 AND y = 1) >= count_if(x1 <= c1) THEN 1 ELSE 0 END AS l1, CASE WHEN 2 * count_if(x1 > c1 AND y = 1) >= count_if(x1 > c1) THEN 1 ELSE 0 END AS h1 FROM t, c)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN 2 * (2 * CASE WHEN x0 <= c0 THEN l0 ELSE h0 END + CASE WHEN x1 <= c1 THEN l1 ELSE h1 END) >= 3 THEN 1 ELSE 0 END AS INTEGER) AS clase FROM t, c, v"""


@query(_FOREST_SQL.replace("l_returnflag = 'R'", "l_linestatus = 'F' AND l_quantity > 10"))
def threshold_forest(spark, d):
    """Trained on the whole table, then asked for every row: three trees of depth 1 over two features."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 10)).cast("int").alias("y"))
    forest = statistics.ThresholdForest(3, 1).fit_table(t, ["l_quantity", "l_tax"], "y")
    return t.select("l_orderkey", "l_linenumber", forest.predict([F.col("l_quantity"), F.col("l_tax")]).alias("clase"))


# Arrays.


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


@query("""SELECT vec_id, round(list_sum(a), 6) AS suma, round(list_avg(a), 6) AS media, list_min(a) AS minimo, list_max(a) AS maximo, round(list_var_pop(a), 6) AS varianza, round(list_stddev_pop(a), 6) AS desviacion, round(list_median(a), 6) AS mediana,
round(list_aggregate(a, 'quantile_cont', 0.9), 6) AS p90 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)""")
def array_statistics(spark, d):
    a = F.col("a")
    out = _embeddings(spark, d).select("vec_id", A.sum_(a).alias("suma"), A.mean(a).alias("media"), A.min_(a).alias("minimo"), A.max_(a).alias("maximo"), A.variance(a).alias("varianza"), A.std(a).alias("desviacion"), A.median(a).alias("mediana"), A.percentile(a, 90).alias("p90"))
    return rounded(out, "suma", "media", "varianza", "desviacion", "mediana", "p90", n=6)


@query("SELECT vec_id, list_position(a, list_min(a)) - 1 AS argmin, list_position(a, list_max(a)) - 1 AS argmax FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)")
def array_arg_extremes(spark, d):
    return _embeddings(spark, d).select("vec_id", A.argmin(F.col("a")).cast("int").alias("argmin"), A.argmax(F.col("a")).cast("int").alias("argmax"))


@query("SELECT vec_id, round(list_dot_product(a, a), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_product(list_transform(a, lambda x: 1 + x / 10)), 6) AS prod FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)")
def array_dot_norm(spark, d):
    a = F.col("a")
    out = _embeddings(spark, d).select("vec_id", A.dot(a, a).alias("dot"), A.norm(a).alias("norm"), A.prod(F.transform(a, lambda x: 1 + x / 10)).alias("prod"))
    return rounded(out, "dot", "norm", "prod", n=6)


@query("""SELECT vec_id, round(list_sum(list_transform(a, lambda x: x + 2)), 6) AS mas, round(list_sum(list_transform(a, lambda x: x - x * x)), 6) AS menos, round(list_sum(list_transform(a, lambda x: x / 4)), 6) AS entre,
len(list_filter(a, lambda x: x > 0)) AS positivos, len(list_filter(a, lambda x: x < 0)) AS negativos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)""")
def array_arithmetic(spark, d):
    a = F.col("a")
    count = lambda m: F.size(F.filter(m, lambda x: x))
    out = _embeddings(spark, d).select(
        "vec_id", A.sum_(A.add(a, F.array(F.lit(2.0)))).alias("mas"), A.sum_(A.subtract(a, A.multiply(a, a))).alias("menos"), A.sum_(A.divide(a, F.array(F.lit(4.0)))).alias("entre"),
        count(A.greater(a, F.array(F.lit(0.0)))).cast("long").alias("positivos"), count(A.less(a, F.array(F.lit(0.0)))).cast("long").alias("negativos"),
    )
    return rounded(out, "mas", "menos", "entre", n=6)


@query("""SELECT vec_id, list_filter(a, lambda x: x > 1) AS mayores, list_transform(list_filter(list_zip(a, range(len(a))), lambda z: z[1] > 1), lambda z: CAST(z[2] AS BIGINT)) AS lugares,
list_transform(a, lambda x: CASE WHEN x > 0 THEN x ELSE 0 END) AS rectificado, a[3:6] AS trozo, list_reverse(a) AS inverso FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)""")
def array_masks(spark, d):
    a = F.col("a")
    m = A.greater_than(a, 1.0)
    return _embeddings(spark, d).select("vec_id", A.mask(a, m).alias("mayores"), A.nonzero(F.transform(m, lambda x: x.cast("int"))).alias("lugares"), A.where(A.greater_than(a, 0.0), a, F.transform(a, lambda x: F.lit(0.0))).alias("rectificado"), A.slice_(a, 2, 6).alias("trozo"), A.slice_(a, None, None, -1).alias("inverso"))


_ROWS_SQL = "(SELECT vec_id, list_transform(range(8), lambda i: a[8 * i + 1:8 * i + 8]) AS filas, list_transform(range(8), lambda j: list_transform(range(8), lambda i: a[8 * i + j + 1])) AS columnas FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings))"


@query(f"SELECT vec_id, list_transform(filas, lambda x: round(list_sum(x), 6)) AS filas, list_transform(columnas, lambda x: round(list_sum(x), 6)) AS columnas, columnas AS traspuesta FROM {_ROWS_SQL}")
def array_matrix(spark, d):
    """Whole embeddings as matrices of 8 by 8."""
    m = A.reshape(F.col("a"), 8, 8)
    r6 = lambda x: signed_round(x, 6)
    return _embeddings(spark, d).select("vec_id", F.transform(A.along(m, 1, A.sum_), r6).alias("filas"), F.transform(A.along(m, 0, A.sum_), r6).alias("columnas"), A.transpose(m).alias("traspuesta"))


def _along(name: str, kernel, sql: str):
    """A reduction of every embedding as a matrix along both axes."""

    def f(spark, d):
        m = A.reshape(F.col("a"), 8, 8)
        r6 = lambda x: signed_round(x, 6)
        return _embeddings(spark, d).select("vec_id", F.transform(A.along(m, 0, kernel), r6).alias("eje0"), F.transform(A.along(m, 1, kernel), r6).alias("eje1"))

    f.__name__ = f"array_axis_{name}"
    query(f"SELECT vec_id, list_transform(columnas, lambda x: round({sql}, 6)) AS eje0, list_transform(filas, lambda x: round({sql}, 6)) AS eje1 FROM {_ROWS_SQL}")(f)


for _name, _op, _sql in (("mean", A.mean, "list_avg(x)"), ("min", A.min_, "list_min(x)"), ("max", A.max_, "list_max(x)"), ("variance", A.variance, "list_var_pop(x)"), ("std", A.std, "list_stddev_pop(x)"), ("median", A.median, "list_median(x)"), ("percentile", lambda x: A.percentile(x, 90), "list_aggregate(x, 'quantile_cont', 0.9)")):
    _along(_name, _op, _sql)


@query("""SELECT vec_id, len(list_filter(a, lambda x: x = a[1])) AS iguales, [isnan(x) FOR x IN (a[1:2] || [CAST('nan' AS DOUBLE)])] AS nan, [isfinite(x) FOR x IN (a[1:2] || [CAST('nan' AS DOUBLE), CAST('inf' AS DOUBLE)])] AS finitos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)""")
def array_flags(spark, d):
    a, odd = F.col("a"), lambda *x: F.concat(F.slice("a", 1, 2), F.array(*(F.lit(float(v)) for v in x)))
    first = F.slice("a", 1, 1)
    return _embeddings(spark, d).select("vec_id", F.size(F.filter(A.equal(a, first), lambda x: x)).cast("long").alias("iguales"), A.isnan(odd("nan")).alias("nan"), A.isfinite(odd("nan", "inf")).alias("finitos"))


@query("SELECT vec_id, list_transform(range(8), lambda i: list_transform(range(8), lambda j: round(a[8 * i + j + 1] + a[j + 1], 6))) AS suma FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)")
def array_broadcast(spark, d):
    """Each matrix plus its first row, which is repeated along the other axis."""
    m = A.reshape(F.col("a"), 8, 8)
    out = A.add_rows(m, A.broadcast_rows(F.slice("a", 1, 8), 8))
    return _embeddings(spark, d).select("vec_id", F.transform(out, lambda x: F.transform(x, lambda y: signed_round(y, 6))).alias("suma"))


@query("SELECT vec_id, list_transform(a, lambda x: CAST(trunc(x * 10) AS INTEGER)) AS enteros FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)")
def array_cast(spark, d):
    return _embeddings(spark, d).select("vec_id", A.cast(F.transform("a", lambda x: x * 10), "int").alias("enteros"))


# Dates and finance.


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS mes, strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH, '%Y-%m-%d') AS trimestre,
CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dias, CAST(epoch(CAST(o_orderdate AS DATE)) / 86400 AS INTEGER) AS epoca,
CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-01-01' THEN 1 WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN -1 ELSE 0 END AS orden FROM orders""")
def dates(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", calendar.parse(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("f"))
    f, day = F.col("f"), lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.select("o_orderkey", day(calendar.add_period(f, "mensual")).alias("mes"), day(calendar.add_period(f, "trimestral")).alias("trimestre"), calendar.days_between(F.lit("1995-01-01").cast("date"), f).alias("dias"), calendar.epoch_days(f).alias("epoca"), calendar.compare(f, F.lit("1996-01-01").cast("date")).alias("orden"))


@query("SELECT p_partkey, round(p_retailprice * power(1.01, p_size), 4) AS futuro, round(p_retailprice / power(1.01, p_size), 4) AS presente FROM part")
def finance_values(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("string").cast(finance.TYPE).alias("p"), "p_size")
    rate = F.lit(Decimal("0.01"))
    out = t.select("p_partkey", finance.future_value_column(F.col("p"), rate, F.col("p_size")).cast("double").alias("futuro"), finance.present_value_column(F.col("p"), rate, F.col("p_size")).cast("double").alias("presente"))
    return rounded(out, "futuro", "presente")


@query("SELECT count(*) AS filas, CAST(round(sum(CAST(p_retailprice AS DECIMAL(18, 4)) * CAST(1 + CAST(0.05 AS DECIMAL(4, 2)) * p_size AS DECIMAL(8, 2))), 2) AS DOUBLE) AS interes_total FROM part")
def simple_interest(spark, d):
    t = table(spark, d, "part").select("p_retailprice", F.lit(0.05).alias("tasa"), "p_size")
    return finance.simple_interest_total(t, "p_retailprice", "tasa", "p_size").select("filas", F.round(F.col("interes_total").cast("double"), 2).alias("interes_total"))


@query("""SELECT o_custkey, round(sum(o_totalprice / power(1.1, i)), 4) AS npv FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY o_custkey""")
def npv(spark, d):
    return rounded(finance.series_npv(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 0.1), "npv")


@query("SELECT o_custkey, round(max(o_totalprice) / min(o_totalprice) - 1, 6) AS irr FROM orders GROUP BY o_custkey HAVING max(o_totalprice) < 11 * min(o_totalprice)")
def irr(spark, d):
    """Each customer pays the least of their orders and gets the greatest a period later; rates beyond 10 are none."""
    both = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    flows = both.select("o_custkey", F.explode(F.array(F.struct(F.lit(0).alias("i"), (-F.col("least")).alias("f")), F.struct(F.lit(1).alias("i"), F.col("most").alias("f")))).alias("x")).select("o_custkey", "x.*")
    return rounded(finance.series_irr(flows, ["o_custkey"], "i", "f"), "irr", n=6).filter("irr is not null")


@query()
def irr_series(spark, d):
    # A hundred of each part are bought, and the orders of the customer with the part's number come in, one a period.
    bought = table(spark, d, "part").select("p_partkey", F.lit(0).cast("long").alias("i"), (F.col("p_retailprice") * -100).cast("double").alias("f"))
    sold = table(spark, d, "orders").select(F.col("o_custkey").alias("p_partkey"), F.col("o_orderkey").cast("long").alias("i"), F.col("o_totalprice").cast("double").alias("f"))
    return rounded(finance.series_irr(bought.unionByName(sold), ["p_partkey"], "i", "f"), "irr", n=6)


@query("""WITH RECURSIVE l AS (SELECT s_suppkey, CAST(abs(s_acctbal) + 100 AS DECIMAL(18, 2)) AS p FROM supplier), k AS (SELECT s_suppkey, p, CAST(round(CAST(p AS DOUBLE) * 0.01 / (1 - power(1.01, -12)), 2) AS DECIMAL(18, 2)) AS pago FROM l),
r AS (SELECT s_suppkey, 1 AS period, pago, p AS antes, CAST(round(p * CAST(0.01 AS DECIMAL(4, 2)), 2) AS DECIMAL(18, 2)) AS interes FROM k
UNION ALL SELECT s_suppkey, period + 1, pago, CAST(antes + interes - pago AS DECIMAL(18, 2)), CAST(round((antes + interes - pago) * CAST(0.01 AS DECIMAL(4, 2)), 2) AS DECIMAL(18, 2)) FROM r WHERE period < 12)
SELECT s_suppkey, CAST(period AS INTEGER) AS period, CAST(CASE WHEN period < 12 THEN pago ELSE antes + interes END AS DOUBLE) AS payment, CAST(interes AS DOUBLE) AS interest, CAST(CASE WHEN period < 12 THEN antes + interes - pago ELSE 0 END AS DOUBLE) AS balance FROM r""")
def amortization(spark, d):
    """Every payment, interest and balance of a loan of twelve periods per supplier."""
    t = table(spark, d, "supplier").select("s_suppkey", F.round(F.abs("s_acctbal") + 100, 2).alias("p"), F.lit(0.01).alias("r"), F.lit(12).alias("n"))
    return finance.amortization_rows(t, ["s_suppkey"], "p", "r", "n").select("s_suppkey", "period", "payment", "interest", "balance")


@query("SELECT p_partkey, round(p_retailprice, 1) AS medio, floor(p_retailprice) AS piso, ceil(p_retailprice) AS techo FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18, 2)) AS p_retailprice FROM part)")
def decimal_rounding(spark, d):
    p = F.col("p_retailprice").cast("decimal(18,2)")
    return table(spark, d, "part").select("p_partkey", finance.round_column(p, 1).cast("double").alias("medio"), finance.round_column(p, 0, "floor").cast("double").alias("piso"), finance.round_column(p, 0, "ceiling").cast("double").alias("techo")).select("p_partkey", "medio", "piso", "techo")


ORACLE["decimal_rounding"] = "SELECT p_partkey, CAST(round(p, 1) AS DOUBLE) AS medio, CAST(floor(p) AS DOUBLE) AS piso, CAST(ceil(p) AS DOUBLE) AS techo FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18, 2)) AS p FROM part)"


@query("SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) * 2 AS DOUBLE) AS doble, 'USD' AS moneda FROM supplier")
def money_sum(spark, d):
    m = finance.money(F.col("s_acctbal").cast("decimal(18,2)"), F.lit("USD"))
    return table(spark, d, "supplier").select("s_suppkey", finance.money_add(m, m).alias("m")).select("s_suppkey", F.col("m.amount").cast("double").alias("doble"), F.col("m.currency").alias("moneda"))


# Functions of scripts, raw SQL, and scripts themselves.

TARIFF = """
funcion tramo(x) { si (x > 30) { retornar x * 2; } sino { si (x > 10) { retornar x + base(x); } } retornar 1; }
funcion base(x) { variable y = x / 2; retornar y + 3; }
funcion factorial(n) { si (n <= 1) { retornar 1; } retornar n * factorial(n - 1); }
"""


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN l_quantity * 2 WHEN l_quantity > 10 THEN l_quantity + l_quantity / 2 + 3 ELSE 1 END AS tramo FROM lineitem")
def udf_function(spark, d):
    f = Functions(parse(TARIFF).functions).column("tramo")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f(F.col("l_quantity")).alias("tramo"))


@query("SELECT l_orderkey, l_linenumber, CAST(factorial(l_linenumber) AS DOUBLE) AS f FROM lineitem")
def udf_recursive(spark, d):
    f = Functions(parse(TARIFF).functions).column("factorial")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f(F.col("l_linenumber")).alias("f"))


RAW = """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2)
SELECT c_mktsegment, count(*) AS clientes, round(avg(total), 2) AS media, max(n) AS mas FROM customer JOIN t ON c_custkey = o_custkey GROUP BY c_mktsegment"""


@query(RAW)
def sql_raw(spark, d):
    for t in ("orders", "customer"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(RAW)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sql_parameters(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ?", args=[2])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
        .agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base"), r(F.sum(price), 2).alias("sum_disc"), r(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), r(F.avg("l_quantity")).alias("avg_qty"), F.count(F.lit(1)).alias("n"))
    )


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def local_supplier_volume(spark, d):
    t = lambda n: table(spark, d, n)
    nations = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lumbre import queries_io  # noqa: F401  it adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


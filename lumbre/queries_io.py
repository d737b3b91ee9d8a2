"""Queries of what lies around the operators: files in and out, documents, scripts, SQL blocks, streams of events, decimals.

Each writes what it needs to a fresh folder that the executors share, and reads it back.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre import operators as O
from lumbre.functions import arrays as A
from lumbre.functions import calendar, finance, statistics
from lumbre.plans.runner import run_script
from lumbre.plans.sql_block import Database
from lumbre.queries import _dirty, _embeddings, _event_stream, _streamed, query, rounded, table
from lumbre.sources import arrow_stream, csv, reports, sqlite, staging
from lumbre.streaming import bounded, events
from lumbre.types import Schema


def _csv(df: DataFrame, label: str, files: int | None = None) -> str:
    at = staging.fresh(df.sparkSession, label)
    (df.coalesce(files) if files else df).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(at)
    return at


def _document(spark: SparkSession, label: str, document: dict) -> str:
    """Published in a folder of this machine, as documents are."""
    at = staging.fresh(spark, label).removeprefix("file://")
    os.makedirs(at)
    reports.publish(document, f"{at}/documento.json")
    return f"{at}/documento.json"


# CSV, Arrow and SQLite.


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', "' || c_mktsegment || '"' AS nombre FROM customer""")
def csv_load(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("nombre"))
    return csv.load_csv(spark, _csv(t, "csv-quotes")).rows


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey >= (SELECT max(o_orderkey) FROM orders) - 5 THEN 'uno' || chr(10) || 'dos' ELSE o_orderpriority END AS texto FROM orders")
def csv_quoted_line_ends(spark, d):
    """The only quoted line ends stand in the last file's last records; files are ranges, so no task sorts all rows."""
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey")).collect()[0][0]
    t = orders.select("o_orderkey", F.when(F.col("o_orderkey") >= last - 5, "uno\ndos").otherwise(F.col("o_orderpriority")).alias("texto"))
    return csv.load_csv(spark, _csv(t.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("string").alias("id"), "texto"), "csv-lines")).rows


def _lines(df: DataFrame, header: str, label: str) -> str:
    """Lines as they are, with the header above each file's."""
    import pandas as pd

    def headed(frames):
        yield pd.DataFrame({"value": [header]})
        yield from frames

    at = staging.fresh(df.sparkSession, label)
    df.mapInPandas(headed, "value string").write.text(at)
    return at


@query("SELECT CASE WHEN event_id % 10 = 0 THEN 'malo' ELSE event_type END AS tipo, count(*) AS n FROM events GROUP BY 1")
def csv_bad_records(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, F.lit("un,campo,de mas")).otherwise(F.concat_ws(",", F.col("event_id").cast("string"), "event_type"))
    got = csv.load_csv(spark, _lines(table(spark, d, "events").select(line.alias("value")), "id,tipo", "csv-bad"))
    return got.rows.groupBy("tipo").agg(F.count(F.lit(1)).alias("n")).unionByName(got.bad().agg(F.lit("malo").alias("tipo"), F.count(F.lit(1)).alias("n")))


@query("SELECT event_type, count(k) AS validos, count(*) - count(k) AS nulos, round(sum(k), 4) AS suma FROM (SELECT event_type, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'no-num' WHEN event_id % 11 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events) GROUP BY 1")
def csv_typed(spark, d):
    t = csv.load_typed(spark, _csv(_dirty(spark, d), "csv-typed"), Schema().declare("k", "numerica").declare("event_type", "categorica"))
    return rounded(t.groupBy("event_type").agg(F.count("k").alias("validos"), F.count_if(F.col("k").isNull()).alias("nulos"), F.sum("k").alias("suma")), "suma")


@query("SELECT l_suppkey % 1000 AS grupo, round(sum(l_quantity), 4) AS suma FROM lineitem GROUP BY 1")
def csv_group_sum(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 1000).alias("grupo"), F.col("l_quantity").alias("valor"))
    rows = csv.load_csv(spark, _csv(t, "csv-groups"), multiline=False).rows
    return rounded(bounded.grouped(rows, ["grupo"], [("suma", "valor")]).select(F.col("grupo").cast("long").alias("grupo"), F.col("v0").alias("suma")), "suma")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def csv_stream_source(spark, d):
    at = _csv(table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type").repartition(3), "csv-stream")
    return _streamed(csv.stream_csv(spark, at, ["event_id", "event_type"]), "csv", "append")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, nullif(l_tax, 0) AS l_tax FROM lineitem")
def arrow_round_trip(spark, d):
    at = staging.fresh(spark, "arrow")
    arrow_stream.write(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")), at)
    return arrow_stream.read(spark, at)


@query("SELECT l_returnflag, l_orderkey FROM lineitem WHERE nullif(l_linenumber, 3) > 2")
def arrow_filter_project(spark, d):
    at, out = staging.fresh(spark, "arrow"), staging.fresh(spark, "arrow-out")
    arrow_stream.write(table(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"), "l_returnflag"), at)
    run_script(spark, f'.analisis a {{ datos desde "{at}" formato arrow_stream filtrar "n" > 2; proyectar {{ "l_returnflag", "l_orderkey" }} guardar resultado en "{out}" }}')
    return arrow_stream.read(spark, out)


@query("SELECT c_custkey, c_name, c_acctbal, nullif(c_nationkey, 3) AS c_nationkey FROM customer")
def sqlite_round_trip(spark, d):
    at = staging.fresh(spark, "sqlite").removeprefix("file://")
    os.makedirs(at)
    t = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", F.nullif(F.col("c_nationkey").cast("long"), F.lit(3)).alias("c_nationkey"))
    sqlite.store(t, f"{at}/base.db", "clientes")
    return sqlite.read(spark, f"{at}/base.db", "clientes")


# Documents.


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def json_rows(spark, d):
    at = staging.fresh(spark, "json")
    reports.write_rows(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), at)
    return spark.read.schema("o_orderkey long, o_orderpriority string").json(at)


@query("SELECT 'paises' AS analisis, (SELECT count(*) FROM nation) AS filas, n_name AS nombre, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def table_document(spark, d):
    t = table(spark, d, "nation").select("n_name", "n_regionkey")
    at = _document(spark, "table", reports.table_report(t, "paises"))
    return spark.read.option("multiLine", True).json(f"file://{at}").select("analisis", "filas", F.explode("datos").alias("x")).select("analisis", "filas", F.col("x.n_name").alias("nombre"), F.col("x.n_regionkey").alias("region"))


@query("SELECT 'n_name' AS nombre, 'texto' AS tipo, 'variable' AS rol UNION ALL SELECT 'n_regionkey', 'numerica', 'entrada_categorica'")
def table_document_columns(spark, d):
    t = O.set_metadata(table(spark, d, "nation").select("n_name", "n_regionkey"), "n_regionkey", {"rol": "entrada_categorica"})
    return spark.createDataFrame([(v["nombre"], v["tipo"], O.column_metadata(t, v["nombre"]).get("rol", v["rol"])) for v in reports.table_report(t, "n")["variables"]], "nombre string, tipo string, rol string")


@query("""SELECT c_mktsegment AS valor, count(*) AS cantidad FROM customer GROUP BY 1""")
def profile_document(spark, d):
    t = table(spark, d, "customer").select(F.col("c_acctbal").cast("string").alias("saldo"), F.col("c_mktsegment").alias("segmento"))
    schema = Schema().declare("saldo", "numerica").declare("segmento", "categorica", "entrada_categorica")
    at = _document(spark, "profile", reports.dataset_profile(t, "clientes", schema))
    return spark.read.option("multiLine", True).json(f"file://{at}").select(F.explode("entradas_categoricas").alias("e")).select(F.explode("e.categorias").alias("c")).select("c.valor", "c.cantidad")


@query("SELECT linea FROM (SELECT 'n_nationkey' || chr(9) || 'n_name' AS linea UNION ALL SELECT n_nationkey || chr(9) || coalesce(nullif(n_name, 'CANADA'), 'nulo') FROM nation)")
def console_rows(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", F.nullif("n_name", F.lit("CANADA")).alias("n_name"))
    return spark.createDataFrame([(x,) for x in reports.show(t, 1000).split("\n")], "linea string")


# Summaries of streams with their accounting, from a CSV.

_ROWS = "(SELECT CASE WHEN event_id % 9 = 0 THEN 'no-num' WHEN event_id % 11 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k, event_type, CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id % 20 AS VARCHAR) END AS u FROM events)"


@query(f"SELECT count(*) AS filas, count(TRY_CAST(k AS DOUBLE)) AS filas_validas, count(*) - count(TRY_CAST(k AS DOUBLE)) AS filas_malformadas, sum(TRY_CAST(k AS DOUBLE)) AS suma FROM {_ROWS}")
def stream_summary_document(spark, d):
    doc = bounded.CsvStream(spark, _csv(_dirty(spark, d), "stream")).summary_document([("suma", "k")])
    return spark.createDataFrame([(doc["filas"], doc["filas_validas"], doc["filas_malformadas"], doc["resultados"][0]["valor"])], "filas long, filas_validas long, filas_malformadas long, suma double")


@query(f"SELECT u AS clave, sum(TRY_CAST(k AS DOUBLE)) AS suma, count(TRY_CAST(k AS DOUBLE)) AS validos, count_if(k = '') AS nulos, count_if(k <> '' AND TRY_CAST(k AS DOUBLE) IS NULL) AS invalidos FROM {_ROWS} GROUP BY u")
def stream_grouped_document(spark, d):
    doc = bounded.CsvStream(spark, _csv(_dirty(spark, d), "stream")).grouped_document(["u"], [("suma", "k")])
    rows = [(r["clave"], m["valor"], m["valores_validos"], m["valores_nulos"], m["valores_invalidos"]) for r in doc["resultados"] for m in r["metricas"]]
    return spark.createDataFrame(rows, "clave string, suma double, validos long, nulos long, invalidos long")


@query(f"SELECT event_type, nullif(u, '') AS u, max(TRY_CAST(k AS DOUBLE)) AS maximo, count_if(k <> '') AS conteo FROM {_ROWS} GROUP BY 1, 2")
def stream_spill_document(spark, d):
    doc = bounded.CsvStream(spark, _csv(_dirty(spark, d), "stream")).grouped_document(["event_type", "u"], [("maximo", "k"), ("conteo", "k")], spill=["t"])
    rows = [(*(c["valor"] for c in r["claves"]), r["metricas"][0]["valor"], int(r["metricas"][1]["valor"])) for r in doc["resultados"]]
    return spark.createDataFrame(rows, "event_type string, u string, maximo double, conteo long")


# Scripts.


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS periodo, round(sum(o_totalprice * 2), 2) AS suma, count(*) AS conteo, round(median(o_totalprice * 2), 4) AS mediana FROM orders WHERE o_totalprice * 2 >= 1000 GROUP BY 1""")
def script_analysis(spark, d):
    t = table(spark, d, "orders").select(F.col("o_totalprice").alias("precio"), F.lit(2).alias("cantidad"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"), F.col("o_orderkey").alias("id"))
    out = run_script(spark, f'''
.analisis ventas {{
    dataset cargar datos("{_csv(t, "script")}")
    variable precio numerica
    variable cantidad numerica
    variable fecha texto
    .limpiar dataset {{ #nulos("eliminar") #duplicados("eliminar") }}
    .transformar dataset {{ #total("precio * cantidad") #periodo("mes de fecha") }}
    .filtrar dataset {{ #condicion("total >= 1000") }}
    .agrupar dataset {{ #por("periodo") #suma("total") #conteo("total") #mediana("total") }}
}}''').tables["ventas"]
    return rounded(rounded(out.select("periodo", F.col("total_suma").alias("suma"), F.col("total_conteo").alias("conteo"), F.col("total_mediana").alias("mediana")), "suma", n=2), "mediana")


@query("SELECT c_mktsegment AS segmento, n_name AS pais, c_acctbal AS saldo FROM customer JOIN nation ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR) WHERE c_acctbal > 0")
def script_join(spark, d):
    left = _csv(table(spark, d, "customer").select(F.col("c_acctbal").alias("saldo"), F.col("c_mktsegment").alias("segmento"), F.col("c_nationkey").alias("clave")), "script")
    right = _csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("clave"), F.col("n_name").alias("pais")), "script")
    out = run_script(spark, f'.analisis c {{ dataset cargar datos("{left}") variable saldo numerica .filtrar dataset {{ #condicion("saldo > 0") }} .unir {{ #derecha("{right}") #clave("clave") #limites(1073741824, 100000000) }} .seleccionar {{ #columnas("segmento, pais, saldo") }} }}')
    return out.tables["c"]


@query(f"SELECT event_type AS clave, sum(TRY_CAST(k AS DOUBLE)) AS suma, CAST(count_if(k <> '') AS DOUBLE) AS conteo FROM {_ROWS} GROUP BY 1")
def script_stream(spark, d):
    at = _csv(_dirty(spark, d), "script")
    out = run_script(spark, f'.analisis f {{ datos desde "{at}" procesar por lotes de 4096 filas con grupos de 1000 agrupar por "event_type" resumir {{ suma de "k"; contar de "k"; }} }}')
    return spark.createDataFrame([(r["clave"], r["metricas"][0]["valor"], r["metricas"][1]["valor"]) for r in out.streams[0]["resultados"]], "clave string, suma double, conteo double")


@query("""SELECT 'perfil_avanzado' AS mando, CAST(count(l_quantity) AS DOUBLE) AS valor FROM lineitem UNION ALL SELECT 'correlacion', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'tasa', round(count_if(l_tax > 0) / sum(l_quantity) * 1000, 6) FROM lineitem UNION ALL SELECT 'modelo_sst', CAST(count(*) AS DOUBLE) FROM lineitem""")
def script_commands(spark, d):
    at = _csv(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", "l_returnflag"), "script")
    out = dict(run_script(spark, f'''.analisis c {{ dataset cargar datos("{at}")
variable l_quantity numerica
variable l_extendedprice numerica
variable l_tax numerica
#perfil_avanzado("l_quantity") #correlacion("l_quantity,l_extendedprice") #tasa("l_tax,l_quantity,1000") #modelo_sst("l_returnflag,l_tax,l_quantity") }}''').commands)
    pick = {"perfil_avanzado": "n", "correlacion": "coeficiente", "tasa": "tasa", "modelo_sst": "eventos"}
    return spark.createDataFrame([(c, round(float(out[c].collect()[0][pick[c]]), 6)) for c in pick], "mando string, valor double")


@query("SELECT * FROM (VALUES ('r', 10.0::DOUBLE), ('cuadrado', 16.0), ('suma(v)', 10.0), ('mediana(v)', 2.5), ('varianza(v)', 1.25), ('percentil(v)', 3.25)) t(nombre, valor)")
def script_values(spark, d):
    out = run_script(spark, "arreglo v = [1, 2, 3, 4]; suma(v); mediana(v); varianza(v); percentil(v, 75); funcion cuadrado(x) { retornar x * x; } variable r = cuadrado(3) + 1; llamar cuadrado(4);")
    return spark.createDataFrame([*((k, float(v)) for k, v in out.values.items()), *((k, float(v)) for k, v in out.statistics)], "nombre string, valor double")


# SQL blocks.


def _database(spark: SparkSession, d: str) -> str:
    at = staging.fresh(spark, "base")
    db = Database(spark, at)
    db.execute("CREATE TABLE paises (id INTEGER, nombre TEXT, region INTEGER, activo BOOLEAN)")
    table(spark, d, "nation").createOrReplaceTempView("origen_nation")
    db.execute("INSERT INTO paises (id, nombre, region, activo) SELECT n_nationkey, n_name, n_regionkey, n_nationkey > 4 FROM origen_nation")
    return at


@query("SELECT n_name AS nombre, n_nationkey > 4 AS activo FROM nation WHERE n_regionkey = 2")
def sql_typed_select(spark, d):
    return run_script(spark, f'sql desde "{_database(spark, d)}" {{ tabla paises (id entero, nombre texto, region entero, activo booleano); seleccionar nombre, activo de paises donde region == 2; }}').sql[0]


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey >= 20 THEN 'Eva' ELSE n_name END AS nombre, CASE WHEN n_nationkey >= 20 THEN false ELSE n_nationkey > 4 END AS activo FROM nation UNION ALL SELECT 99, 'x''); DROP TABLE paises; --', NULL")
def sql_typed_changes(spark, d):
    """Typed insert and update in a transaction that is committed, and another that is undone."""
    at = _database(spark, d)
    run_script(spark, f'''sql desde "{at}" {{ tabla paises (id entero, nombre texto, region entero, activo booleano);
iniciar; actualizar paises establecer nombre = "Eva", activo = falso donde id >= 20; insertar en paises (id, nombre) valores (99, "x'); DROP TABLE paises; --"); confirmar; }}''')
    db = Database(spark, at)
    db.begin()
    db.execute("DELETE FROM paises WHERE id < 10")
    db.rollback()
    return db.table("paises").select("id", "nombre", "activo")


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def sql_block_query(spark, d):
    """Delete, then a query with parameters and limits."""
    at = _database(spark, d)
    return run_script(spark, f'sql desde "{at}" limites filas 1000 bytes 65536 tiempo 30000 {{ ejecutar "DELETE FROM paises WHERE id < 5"; consulta "SELECT region, count(*) AS n FROM paises WHERE id >= ? GROUP BY region" con (1); }}').sql[0]


# Event time.


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1""")
def streaming_sliding(spark, d):
    out = events.windowed(_event_stream(spark, d), "ts", "10 minutes", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n"))
    return _streamed(out, "sliding", "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "n")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def streaming_session(spark, d):
    out = events.session_windows(_event_stream(spark, d), "ts", "10 minutes", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return _streamed(out, "session", "complete").select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "n")


@query("SELECT a.event_id AS vista, b.event_id AS compra FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def streaming_join(spark, d):
    e = lambda: _event_stream(spark, d)
    views, buys = e().filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("vista")), e().filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("ts2"), F.col("event_id").alias("compra"))
    return _streamed(events.interval_join(views, buys, "user_id", "ts", "ts2", "1 day", "1 HOUR").select("vista", "compra"), "join", "append")


# Decimals, money, dates, columns.


@query("SELECT p_partkey, CAST(p + 1.5 AS VARCHAR) AS suma, CAST(p - 0.25 AS VARCHAR) AS resta, CASE WHEN p > 1000 THEN 1 WHEN p < 1000 THEN -1 ELSE 0 END AS orden FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18, 2)) AS p FROM part)")
def decimal_arithmetic(spark, d):
    p, lit = F.col("p_retailprice").cast("decimal(18,2)"), lambda x: F.lit(x).cast("decimal(3,2)")
    return table(spark, d, "part").select("p_partkey", (p + lit("1.5")).cast("decimal(18,2)").cast("string").alias("suma"), (p - lit("0.25")).cast("decimal(18,2)").cast("string").alias("resta"), calendar.compare(p, F.lit(1000)).alias("orden"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN event_id + 0.125 WHEN 2 THEN NULL ELSE -event_id END AS valor FROM events")
def decimal_parse(spark, d):
    text = F.element_at(F.array(F.col("event_id").cast("string"), F.concat(F.col("event_id").cast("string"), F.lit(".125")), F.lit("1e5"), F.concat(F.lit("-"), F.col("event_id").cast("string"), F.lit(".000"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", finance.parse_column(text).cast("double").alias("valor"))


@query("SELECT p_partkey, round(CAST(p_retailprice AS DOUBLE) / p_size, 9) AS cociente, round(power(1 + p_size / 100.0, 3), 6) AS potencia FROM part")
def decimal_divide_power(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("string").cast(finance.TYPE).alias("p"), F.col("p_size").cast(finance.TYPE).alias("n"))
    out = t.select("p_partkey", finance.divide_column(F.col("p"), F.col("n"), 12).cast("double").alias("cociente"), finance.power_column((1 + F.col("n") / 100).cast(finance.TYPE), F.lit(3)).cast("double").alias("potencia"))
    return rounded(rounded(out, "cociente", n=9), "potencia", n=6)


@query("SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) - 1 AS DOUBLE) AS resto, 'USD' AS moneda FROM supplier")
def money_difference(spark, d):
    m = lambda c: finance.money(c.cast("decimal(18,2)"), F.lit("USD"))
    return table(spark, d, "supplier").select("s_suppkey", finance.money_sub(m(F.col("s_acctbal")), m(F.lit(1))).alias("m")).select("s_suppkey", F.col("m.amount").cast("double").alias("resto"), F.col("m.currency").alias("moneda"))


@query("""SELECT o_orderkey, round(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 365.0, 9) AS f365, round(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 360.0, 9) AS f360,
strftime(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH, '%Y-%m-%d') AS semestre, strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH, '%Y-%m-%d') AS anual,
strftime(CASE WHEN CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) THEN last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) ELSE CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH END, '%Y-%m-%d') AS fin, CAST(o_orderdate AS DATE) > DATE '1996-06-30' AS futura FROM orders""")
def periods(spark, d):
    f, start, day = F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"), lambda c: F.date_format(c, "yyyy-MM-dd")
    out = table(spark, d, "orders").select("o_orderkey", calendar.period_fraction(start, f, 365).cast("double").alias("f365"), calendar.period_fraction(start, f, 360).cast("double").alias("f360"), day(calendar.add_period(f, "semestral")).alias("semestre"), day(calendar.add_period(f, "anual")).alias("anual"), day(calendar.add_period(f, "mensual", stick_to_end=True)).alias("fin"), calendar.is_future(f, F.lit("1996-06-30").cast("date")).alias("futura"))
    return rounded(out, "f365", "f360", n=9)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'bajo' WHEN 1 THEN 'medio' END AS nivel FROM orders")
def categorical_column(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderkey") % 3, F.lit(2)).alias("codigo"))
    return O.add_categorical(t, "nivel", "codigo", ["bajo", "medio"]).drop("codigo")


@query("SELECT vec_id, [2, 3] AS forma, CAST(0 AS DOUBLE) AS suma, list_transform(a, lambda x: CAST(x AS FLOAT)) AS valores FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)")
def array_creation(spark, d):
    z = A.zeros(2, 3)
    return _embeddings(spark, d).select("vec_id", A.shape(z, 2).alias("forma"), A.sum_(A.flatten(z)).alias("suma"), A.cast(F.col("a"), "float").alias("valores"))


@query("SELECT round(e / x * 1000, 6) AS tasa, round(greatest(0, (e - 1.959963984540054 * sqrt(e)) / x * 1000), 6) AS inferior, round((e + 1.959963984540054 * sqrt(e)) / x * 1000, 6) AS superior FROM (SELECT CAST(count_if(l_returnflag = 'R') AS DOUBLE) AS e, sum(l_quantity) AS x FROM lineitem)")
def poisson_normal(spark, d):
    r = table(spark, d, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("e"), F.sum("l_quantity").alias("x")).collect()[0]
    return spark.createDataFrame([tuple(round(v, 6) for v in statistics.poisson_normal_interval(r["e"], r["x"], 1000))], "tasa double, inferior double, superior double")


@query("SELECT count(*) AS n FROM nation")
def validated_table(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", "n_name")
    return O.validate(t, t.schema).agg(F.count(F.lit(1)).alias("n"))


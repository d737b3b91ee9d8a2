"""Relational operators on small tables."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre import operators as O
from lumbre.errors import EngineError, translated
from lumbre.operators.aggregate import Metric, integer_sum
from lumbre.operators.combine import guarded, right_names, row_bytes
from lumbre.types import Schema, as_text, binary, iso_date, promote, risk_name, safe_number

NAN = float("nan")


def values(df, name):
    return [r[name] for r in df.collect()]


def fails(code, f):
    with pytest.raises(EngineError) as e, translated():
        f()
    assert e.value.code == code


def test_numbers_and_their_grammar(spark):
    texts = ["1", " 2.5\t", "1e3", ".5", "5.", "", "x", "1d", "NaN", "inf", "1e400", "0x10", "1 2", None, "-7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(safe_number(F.col("t")).alias("v")), "v") == [1, 2.5, 1000, 0.5, 5, None, None, None, None, None, None, None, None, None, -7]


def test_dates_are_strict(spark):
    df = spark.createDataFrame([(t,) for t in ("2024-02-29", "2023-02-29", "2024-2-9", "2024-02-09 ", "x", None)], "t string")
    assert [v is not None for v in values(df.select(iso_date(F.col("t")).alias("v")), "v")] == [True, False, False, False, False, False]


def test_schema_reads_and_nulls(spark):
    df = spark.createDataFrame([("1", "", "a"), ("x", "b", None)], "n string, c string, t string")
    out = Schema().declare("n", "numerica").declare("c", "categorica", "entrada_categorica").apply(df)
    assert [tuple(r) for r in out.collect()] == [(1.0, None, "a"), (None, "b", None)]
    assert out.schema["c"].metadata["rol"] == "entrada_categorica"
    fails("DATA", lambda: Schema().declare("zz", "texto").apply(df))
    fails("TYPE", lambda: Schema().declare("n", "otro"))


def test_labels(spark):
    df = spark.createDataFrame([("SI", "Caída"), ("no", "químico"), ("", "x")], "b string, r string")
    assert values(df.select(binary(F.col("b")).alias("v")), "v") == [True, False, None]
    assert values(df.select(risk_name(F.col("r")).alias("v")), "v") == ["caida", "quimico", "desconocido"]
    assert values(as_text(spark.createDataFrame([(True,), (None,)], "b boolean")), "b") == ["verdadero", None]


@pytest.mark.parametrize(("a", "b", "c"), [("int8", "int16", "int16"), ("uint8", "int8", "int16"), ("uint32", "int64", "int64"), ("uint64", "int8", "float64"), ("float32", "int16", "float32"), ("float32", "int32", "float64"), ("bool", "int8", "int8"), ("uint16", "uint32", "uint32")])
def test_promotion(a, b, c):
    assert promote(a, b) == promote(b, a) == c


def test_filters(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (2.0,)], "v double")
    assert values(O.filter_number(df, "v", "<", 2), "v") == [1.0]
    with pytest.raises(Exception, match="not finite"):
        O.filter_number(df, "v", ">", 1).collect()
    wide = spark.createDataFrame([(2**53 - 1,), (2**53,), (2**53 + 1,), (2**63 - 1,), (None,)], "v long")
    assert values(O.filter_number(wide, "v", ">", 9007199254740992), "v") == [2**53 + 1, 2**63 - 1]
    assert O.filter_number(wide, "v", "<", 1e30).count() == 4 and O.filter_number(wide, "v", "==", 0.5).count() == 0
    fails("TYPE", lambda: O.filter_number(df.select(F.lit("x").alias("t")), "t", ">", 1))
    fails("DATA", lambda: O.filter_number(df, "zz", ">", 1))


def test_conditions():
    assert O.parse_condition("precio >= 10.5") == ("precio", ">=", 10.5)
    for bad in ("precio>=10", "precio >= x", "precio = 3", "precio > nan"):
        with pytest.raises(EngineError):
            O.parse_condition(bad)


def test_product_and_month(spark):
    df = spark.createDataFrame([(10.0, 2.0, "2026-01-01"), (None, 3.0, None)], "precio double, cantidad double, fecha string")
    assert values(O.add_product(df, "precio", "cantidad"), "total") == [20.0, None]
    assert values(O.add_month(df), "periodo") == ["2026-01", None]
    with pytest.raises(Exception, match="not a date"):
        O.add_month(df.withColumn("fecha", F.lit("2026-13-01"))).collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        O.add_product(spark.createDataFrame([(1e300, 1e300)], "a double, b double"), "a", "b").collect()
    fails("DATA", lambda: O.add_product(df, "precio", "cantidad", "fecha"))


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (None, None), (None, None)], "id int, name string")
    assert O.drop_duplicates(df).count() == 3 and O.drop_nulls(df).count() == 3
    floats = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, NAN), (3, NAN), (4, 0.0)], "i long, v double")
    assert sorted(values(O.keep_first(floats, "i"), "i")) == [0, 1, 2]
    assert O.drop_nulls(floats).count() == 5  # NaN is a value


def test_fill(spark):
    df = spark.createDataFrame([(None, NAN, None), (1, None, "x")], "i int, d double, s string")
    assert values(O.fill_null(df, "i", 7), "i") == [7, 1]
    assert math.isnan(values(O.fill_null(df, "d", 0.5), "d")[0])
    fails("TYPE", lambda: O.fill_null(df, "i", 1.5))
    fails("TYPE", lambda: O.fill_null(df, "s", 1))
    fails("OVERFLOW", lambda: O.fill_null(df, "i", 2**40))


def test_groups(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 0, 20), (2, 0, None), (2, 1, 4), (1, 0, 5)], "k long, sub long, v int")
    out = O.grouped(df, ["k", "sub"], [Metric("suma", "v"), Metric("conteo", "v")])
    assert {tuple(r) for r in out.collect()} == {(1, 0, 35, 3), (2, 0, None, 0), (2, 1, 4, 1)}
    assert out.columns == ["k", "sub", "v_suma", "v_conteo"]
    fails("DATA", lambda: O.grouped(df, ["k"], [Metric("suma", "v"), Metric("suma", "v")]))
    fails("TYPE", lambda: O.grouped(df.withColumn("t", F.lit("x")), ["k"], [Metric("suma", "t")]))
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(1, 127), (1, 1)], "g long, x byte").groupBy("g").agg(integer_sum(F.col("x"), 8)).collect()


def test_nan_in_groups(spark):
    df = spark.createDataFrame([(NAN, 1.0), (NAN, NAN), (1.0, 3.0)], "k double, v double")
    out = {str(r.k): r for r in O.grouped(df, ["k"], [Metric("minimo", "v"), Metric("maximo", "v"), Metric("conteo", "v")]).collect()}
    assert math.isnan(out["nan"].v_minimo) and math.isnan(out["nan"].v_maximo) and out["1.0"].v_minimo == 3.0 and out["nan"].v_conteo == 2


def test_summary_order_and_empty(spark):
    df = spark.createDataFrame([(10.0,), (5.0,), (9.0,), (5.0,), (-1.0,)], "precio double")
    out = O.summary(df, [Metric("percentil", "precio", 90), Metric("suma", "precio"), Metric("mediana", "precio"), Metric("varianza", "precio")])
    assert out.columns[0] == "precio_suma"
    r = out.collect()[0]
    assert r.precio_suma == 28 and r.precio_mediana == 5 and abs(r.precio_percentil_90 - 9.6) < 1e-12 and abs(r.precio_varianza - 15.04) < 1e-9
    assert O.summary(df.limit(0), [Metric("conteo", "precio"), Metric("suma", "precio")]).collect()[0][0] == 0


def test_hundred_thousand_rows_in_a_thousand_groups(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).alias("k"), F.lit(1).alias("v"))
    assert {r.v_suma for r in O.grouped(df, ["k"], [Metric("suma", "v")]).collect()} == {100}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "key long, value string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "key long, value string")
    assert [O.join(left, right, ["key"], how=h).count() for h in ("inner", "left", "right", "full", "semi", "anti")] == [4, 6, 6, 8, 2, 2]
    assert O.join(left, right, ["key"]).columns == ["key", "value", "key_right", "value_right"]
    assert right_names(["x", "x_right"], ["x"]) == ["x_right2"]
    for hint in ("broadcast", "merge", "hash", "nested_loop"):
        assert O.join(left, right, ["key"], hint=hint).count() == 4
    fails("TYPE", lambda: O.join(left, right.withColumn("key", F.col("key").cast("int")), ["key"]))
    fails("OVERFLOW", lambda: O.join(left, right, ["key"], max_rows=3))
    fails("OVERFLOW", lambda: O.join(left, right, ["key"], max_bytes=20))
    fails("OVERFLOW", lambda: guarded(left, 3))
    for how in ("inner", "left", "right", "full", "semi", "anti"):
        kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
        out = O.join(left, right, ["key"], how=how)
        assert O.join_size(left, right, ["key"], ["key"], kind)[0] == out.count()
        assert O.join_size(left, right, ["key"], ["key"], kind)[1] == out.agg(F.sum(row_bytes(out))).collect()[0][0]
    fails("OVERFLOW", lambda: O.cross_join(left, right, max_rows=15))
    floats = lambda *v: spark.createDataFrame([(x,) for x in v], "k double")
    assert O.join(floats(NAN, -0.0), floats(NAN, 0.0), ["k"]).count() == 2


def test_as_of_and_band(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k long, t long, v string")
    out = {(r.k, r.t): r.v for r in O.as_of_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert out == {(1, 5): "b", (1, 1): None, (2, 9): None}
    a, b = spark.range(30).select(F.col("id").cast("double").alias("x")), spark.range(30).select((F.col("id") * 1.5).alias("y"))
    assert O.band_join(a, b, "x", "y", 2.0).count() == sum(abs(i - j * 1.5) <= 2 for i in range(30) for j in range(30))


def test_sort_puts_nan_then_null_last(spark):
    df = spark.createDataFrame([(0, 2.0, "b"), (1, NAN, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, None, "a"), (5, 3.0, "a")], "id long, value double, name string")
    assert values(O.sort(df, [("value", False)], "id"), "id") == [2, 0, 3, 5, 1, 4]
    assert values(O.sort(df, [("value", True)], "id"), "id") == [5, 0, 3, 2, 1, 4]
    assert values(O.sort(df, [("name", False), ("value", True)], "id"), "id") == [5, 2, 1, 4, 0, 3]
    assert values(O.top_k(df, [("value", True)], 1, ["name"]), "id") == [5, 0]


def test_unpivot_select_metadata(spark):
    df = spark.createDataFrame([(10, 1.0, 3.0), (11, 2.0, 4.0)], "id long, a double, b double")
    assert values(O.unpivot(df, ["id"], ["a", "b"]), "value") == [1.0, 3.0, 2.0, 4.0]
    fails("TYPE", lambda: O.unpivot(df.withColumn("b", F.lit("x")), ["id"], ["a", "b"]))
    fails("ARGUMENT", lambda: O.select(df, ["a", "a"]))
    assert O.column_metadata(O.set_metadata(df, "a", {"unidad": "m"}), "a") == {"unidad": "m"}
    assert O.validate(df, df.schema) is df
    fails("TYPE", lambda: O.validate(df, T.StructType(df.schema[:2])))


def test_states_merge_like_the_whole(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", ""), ("b", "5"), ("a", "4"), ("a", "10")], "k string, v string")
    days = O.partial_state(df.limit(3), ["k"], "v", True).unionByName(O.partial_state(df.offset(3), ["k"], "v", True))
    out = {r.k: r for r in O.final_state(O.merge_states(days, ["k"]), ["k"]).collect()}
    a = out["a"]
    assert (a.conteo, a.nulos, a.invalidos, a.suma, a.minimo, a.maximo) == (3, 1, 1, 15.0, 1.0, 10.0)
    assert abs(a.varianza - 14) < 1e-9 and abs(a.varianza_muestral - 21) < 1e-9 and out["b"].varianza_muestral == 0


def test_categories(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "c int")
    assert values(O.add_categorical(df, "color", "c", ["rojo", "azul"]), "color") == ["rojo", "azul", None]
    with pytest.raises(Exception, match="without label"):
        O.add_categorical(spark.createDataFrame([(2,)], "c int"), "color", "c", ["rojo", "azul"]).collect()


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = [*rng.normal(size=4000).tolist(), *[0.5] * 3000, 1e12, -1e-300]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    ps = [0, 10, 33.3, 50, 75, 99, 100]
    for few in (10**6, 3):
        got = {r.p: r.value for r in O.exact_percentiles(df, "v", ps, few).collect()}
        assert [got[float(p)] for p in ps] == pytest.approx([float(np.percentile(v, p)) for p in ps], rel=1e-12)
    assert O.exact_percentiles(df.limit(0), "v", [50]).collect()[0].value is None
    assert math.isnan(O.exact_percentiles(spark.createDataFrame([(NAN,), (1.0,)], "v double"), "v", [50]).collect()[0].value)


def test_scan_plan():
    from lumbre.session import scan_partitions, scan_settings

    assert scan_partitions(10, 4) == [(0, 4), (4, 4), (8, 2)] and len(scan_partitions(10**9, 1)) <= 4096 and scan_partitions(0, 4) == []
    assert scan_settings(100, 30)["spark.sql.shuffle.partitions"] == "4"

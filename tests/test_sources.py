"""CSV, Arrow streams, SQLite files and documents."""

import json
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.sources import arrow_stream, csv, reports, sqlite
from lumbre.types import Schema


def put(folder, name, text):
    at = folder / name
    at.write_bytes(text.encode())
    return str(at)


def test_csv_counts_bad_rows(spark, tmp_path):
    at = put(tmp_path, "a.csv", 'id,importe\n1,10\n\n2,20,30\n3\n4,"a ""b"""\n')
    t = csv.load_csv(spark, at)
    assert [tuple(r) for r in t.rows.collect()] == [("1", "10"), ("4", 'a "b"')]
    assert t.invalid_rows() == 2 and t.bad().count() == 2


def test_csv_quoted_newlines_crlf_and_limits(spark, tmp_path):
    at = put(tmp_path, "b.csv", 'id,nota\r\n1,"dos\r\nlineas"\r\n2,x')
    t = csv.load_csv(spark, at)
    assert [r.nota.replace("\r", "") for r in t.rows.collect()] == ["dos\nlineas", "x"] and t.invalid_rows() == 0
    for options in ({"max_bytes": 5}, {"max_rows": 1}):
        with pytest.raises(EngineError) as e:
            csv.load_csv(spark, at, **options)
        assert e.value.code == "LIMIT"
    for text in ("a,a\n1,2\n", "a,\n1,2\n", ""):
        with pytest.raises(EngineError) as e:
            csv.load_csv(spark, put(tmp_path, "c.csv", text))
        assert e.value.code == "DATA"
    with pytest.raises(EngineError) as e:
        csv.load_csv(spark, str(tmp_path / "none.csv"))
    assert e.value.code == "IO"


def test_typed_csv(spark, tmp_path):
    at = put(tmp_path, "d.csv", "precio;ciudad\n10;Caracas\n;\nx;Maracaibo\n")
    df = csv.load_typed(spark, at, Schema().declare("precio", "numerica"), delimiter=";")
    assert [tuple(r) for r in df.collect()] == [(10.0, "Caracas"), (None, None), (None, "Maracaibo")]


def test_paths(tmp_path):
    assert csv.resolve("s3://x/y") == "s3://x/y" and csv.resolve("nada.csv", str(tmp_path)) == str(tmp_path / "nada.csv") and csv.resolve("o.json", str(tmp_path), output=True) == str(tmp_path / "o.json")


def stream_file(path, table, batch=3):
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table, max_chunksize=batch)


def test_arrow_streams(spark, tmp_path):
    wide = pa.table({"wide": pa.array([2**53 - 1, 2**53, 2**53 + 1, 2**63 - 1, None], pa.int64()), "t": pa.array(["a", None, "c", "d", "e"]), "u": pa.array([1, 2, 3, 4, 5], pa.uint8())})
    stream_file(tmp_path / "in.arrows", wide)
    df = arrow_stream.read(spark, str(tmp_path / "in.arrows"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "smallint"] and df.count() == 5
    out = arrow_stream.transform(spark, str(tmp_path / "in.arrows"), str(tmp_path / "out"), ("wide", ">", 9007199254740992), ["t", "wide"])
    assert [tuple(r) for r in out.collect()] == [("c", 2**53 + 1), ("d", 2**63 - 1)]
    back = arrow_stream.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [("c", 2**53 + 1), ("d", 2**63 - 1)] and back.columns == ["t", "wide"]
    arrow_stream.write(df.repartition(3), str(tmp_path / "out"))
    assert arrow_stream.read(spark, str(tmp_path / "out"), ["u"]).agg(F.sum("u")).collect()[0][0] == 15
    assert not list((tmp_path / "out").glob("*.staged"))


def test_arrow_refuses_nested_and_missing(spark, tmp_path):
    stream_file(tmp_path / "n.arrows", pa.table({"l": pa.array([[1]])}))
    with pytest.raises(Exception, match="flat scalar"):
        arrow_stream.read(spark, str(tmp_path / "n.arrows"))
    stream_file(tmp_path / "m.arrows", pa.table({"x": pa.array([1])}))
    with pytest.raises(Exception, match="does not exist"):
        arrow_stream.read(spark, str(tmp_path / "m.arrows"), ["zz"])


def test_sqlite_files(spark, tmp_path):
    at = str(tmp_path / "db.sqlite")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE records (id INTEGER PRIMARY KEY, note TEXT, maybe INTEGER, r REAL)")
        c.executemany("INSERT INTO records VALUES (?, ?, ?, ?)", [(i, f"ñ{i}", None if i % 2 else i, i / 2) for i in range(1, 101)])
    df = sqlite.read(spark, at, "records")
    assert df.count() == 100 and df.filter("maybe is null").count() == 50 and df.agg(F.sum("r")).collect()[0][0] == 2525
    assert sqlite.tables(at) == ["records"]
    sqlite.store(df.filter("id < 4"), at, "few")
    assert sorted(map(tuple, sqlite.read(spark, at, "few").select("id", "note").collect())) == [(1, "ñ1"), (2, "ñ2"), (3, "ñ3")]
    with pytest.raises(Exception, match="does not exist"):
        sqlite.read(spark, at, "zz")


def test_documents(spark, tmp_path):
    schema = Schema().declare("edad", "numerica").declare("ciudad", "categorica", "entrada_categorica").declare("compro", "binaria", "salida_binaria")
    raw = spark.createDataFrame([("20", "A", "si"), ("x", "B", "0"), ("40", "A", "quizas"), ("", "", "1")], "edad string, ciudad string, compro string")
    doc = reports.table_report(schema.apply(raw), "t", schema)
    assert list(doc) == ["analisis", "filas", "columnas", "variables", "entradas_categoricas", "salidas_binarias", "datos"] and doc["filas"] == 4 and doc["datos"][1]["edad"] is None
    p = reports.dataset_profile(raw, "t", schema, 2)
    assert p["variables"][0]["validos"] == 2 and p["variables"][0]["invalidos"] == 2 and p["variables"][0]["promedio"] == 30
    assert p["entradas_categoricas"][0] == {"variable": "ciudad", "nulos": 1, "categorias": [{"valor": "A", "cantidad": 2}, {"valor": "B", "cantidad": 1}]}
    assert p["salidas_binarias"][0]["unos"] == 2 and p["salidas_binarias"][0]["ceros"] == 1 and p["filas_invalidas"] == 2
    at = tmp_path / "r.json"
    reports.publish({"a": float("nan"), "b": "ñ\n"}, str(at))
    assert json.loads(at.read_text())["b"] == "ñ\n" and [f.name for f in tmp_path.iterdir()] == ["r.json"]
    with pytest.raises(EngineError):
        reports.publish({}, str(tmp_path / "no" / "r.json"))
    with pytest.raises(EngineError):
        reports.rows_of(raw, 2)
    assert reports.show(raw, 1).splitlines() == ["edad\tciudad\tcompro", "20\tA\tsi"]
    reports.write_rows(raw, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 4


def test_sales(spark):
    df = spark.createDataFrame([("10", "2"), ("5", "3"), ("2", "4"), ("x", "1"), ("-1", "5")], "precio string, cantidad string")
    r = reports.sales_summary(df, "precio", "cantidad").collect()[0]
    assert (r.total, r.filas_vistas, r.filas_usadas, r.filas_rechazadas, r.maxima, r.minima) == (43, 5, 3, 2, 20, 8)

"""Scripts from text to documents: analyses, streams, Arrow, SQL, functions, and what the parser refuses."""

import json

import pytest

from lumbre.errors import EngineError
from lumbre.plans.parser import parse
from lumbre.plans.runner import run_file, run_script
from lumbre.plans.sql_block import Database


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())


def run(spark, folder, text):
    put(folder, "s.script", text)
    return run_file(spark, str(folder / "s.script"))


def doc(folder, name):
    return json.loads((folder / name).read_text())


SALES = "precio,cantidad,ciudad,fecha\n10,2,Caracas,2026-01-05\n10,2,Caracas,2026-01-05\n5,3,Maracaibo,2026-02-01\n2,4,,2026-02-03\n9,1,Caracas,2026-02-04\n"


def test_analysis_end_to_end(spark, tmp_path):
    put(tmp_path, "v.csv", SALES)
    put(tmp_path, "r.csv", "ciudad,region\nCaracas,Centro\nMaracaibo,Occidente\n")
    out = run(spark, tmp_path, """
.analisis ventas {
    dataset cargar datos("v.csv")   // la carga
    variable precio numerica
    variable cantidad numerica
    variable ciudad categorica
    variable fecha texto
    .limpiar dataset { #nulos("eliminar") #duplicados("eliminar") }
    .transformar dataset { #total("precio * cantidad") #periodo("mes de fecha") }
    .filtrar dataset { #condicion("total >= 9") }
    .unir { #derecha("r.csv") #clave("ciudad") #limites(65536, 100) }
    .agrupar dataset { #por("periodo") #suma("total") #conteo("total") #mediana("total") }
    .exportar { ("salida.json") }
}""")
    rows = {r["periodo"]: r for r in doc(tmp_path, "salida.json")["datos"]}
    assert rows["2026-01"]["total_suma"] == 20 and rows["2026-02"]["total_suma"] == 24 and rows["2026-02"]["total_conteo"] == 2 and rows["2026-02"]["total_mediana"] == 12
    assert out.written == [str(tmp_path / "salida.json")]


def test_commands_write_documents(spark, tmp_path):
    rows = "\n".join(f"{k},{2 * k + (k % 3)},{'A' if k % 2 else 'B'},{'si' if k % 4 < 2 else 'no'}" for k in range(1, 41))
    put(tmp_path, "p.csv", f"antes,despues,grupo,evento\n{rows}\n")
    out = run(spark, tmp_path, """
.analisis todo {
    dataset cargar datos("p.csv")
    variable antes numerica
    variable despues numerica
    entrada categorica grupo
    salida binaria evento
    .exportar { ("o.json") }
    #perfil_avanzado("antes") #histograma("antes") #normalidad("despues") #tasa("antes,despues,1000") #poisson("antes,despues,1000")
    #correlacion("antes,despues") #wilcoxon("antes,despues") #chi_cuadrado("grupo,evento") #riesgo("grupo,evento,A,si") #modelo_sst("grupo,evento,antes") #interes_simple("antes,despues,antes")
}""")
    assert len(out.commands) == 11 and len(out.written) == 12
    assert doc(tmp_path, "o.json.histograma.json")["bins"] == [8, 8, 8, 8, 8]
    assert doc(tmp_path, "o.json.sst.json")["n"] == 40 and doc(tmp_path, "o.json.modelo_sst.json")["eventos"] == 40
    assert list(doc(tmp_path, "o.json.poisson.json")) == ["operacion", "eventos", "tasa", "ic_inferior", "ic_superior"]
    assert doc(tmp_path, "o.json")["salidas_binarias"] == [{"variable": "evento"}]


def test_streams(spark, tmp_path):
    put(tmp_path, "f.csv", "zona,importe,referencia\nNorte,5,r1\nSur,1,r2\nNorte,no-num,r3\nSur,4,\n")
    out = run(spark, tmp_path, """
.analisis flujo {
    datos desde "f.csv" procesar por lotes de 4096 filas con registros de hasta 8 MiB con grupos de 10 con filas hasta 100 con tiempo hasta 600000 ms
    agrupar por "zona" resumir { suma de "importe"; contar de "referencia"; varianza de "importe"; }
    guardar resultado en "g.json"
}""")
    d = doc(tmp_path, "g.json")
    assert [(r["clave"], r["metricas"][0]["valor"], r["metricas"][0]["valores_invalidos"], r["metricas"][1]["valor"], r["metricas"][1]["valores_nulos"]) for r in d["resultados"]] == [("Norte", 5, 1, 2, 0), ("Sur", 5, 0, 1, 1)]
    assert d["resultados"][0]["metricas"][2]["valor"] == 0 and d["modo"] == "flujo_agrupado" and d["filas"] == 4
    put(tmp_path, "q.csv", 'id,importe\n1,10.0\n2,20.0\n3,"30.0"\n4,no-num\n5\n')
    out = run(spark, tmp_path, '.analisis f { datos desde "q.csv" filtrar "importe" > 10; resumir { suma de "importe"; contar de "importe"; } }')
    s = out.streams[0]
    assert (s["filas"], s["filas_validas"], s["filas_malformadas"], s["resultados"][0]["valor"]) == (5, 2, 1, 50)


def test_stream_two_keys_and_spill(spark, tmp_path):
    put(tmp_path, "k.csv", 'region,segmento,valor\nnorth,alpha,1\nnorth,alpha,3\nnorth,"comma,colon:pipe|",2\nnorth,,5\nno,z,1\n')
    out = run(spark, tmp_path, '.analisis f { datos desde "k.csv" agrupar por "region", "segmento" #spill("t", 4096, 65536, 64, 100) resumir { suma de "valor"; conteo de "valor"; } }')
    keys = [tuple(c["valor"] for c in r["claves"]) for r in out.streams[0]["resultados"]]
    assert keys == [("no", "z"), ("north", None), ("north", "alpha"), ("north", "comma,colon:pipe|")]
    with pytest.raises(EngineError) as e:
        run(spark, tmp_path, '.analisis f { datos desde "k.csv" con grupos de 2 agrupar por "segmento" resumir { suma de "valor"; } }')
    assert e.value.code == "LIMIT"
    with pytest.raises(EngineError) as e:
        run(spark, tmp_path, '.analisis f { datos desde "k.csv" con filas hasta 2 resumir { suma de "valor"; } }')
    assert e.value.code == "LIMIT"
    put(tmp_path, "bad.csv", "a,b\n1,2\n3\n")
    with pytest.raises(EngineError) as e:
        run(spark, tmp_path, '.analisis f { datos desde "bad.csv" agrupar por "a" resumir { suma de "b"; } }')
    assert e.value.code == "DATA"


def test_arrow_script(spark, tmp_path):
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "e.arrows"), "wb") as f, pa.ipc.new_stream(f, pa.schema([("n", pa.int64()), ("t", pa.string())])) as out:
        out.write_table(pa.table({"n": [1, 5, None], "t": ["a", "b", "c"]}))
    r = run(spark, tmp_path, '.analisis a { datos desde "e.arrows" formato arrow_stream filtrar "n" > 2; proyectar { "t", "n" } guardar resultado en "o" }')
    assert [tuple(x) for x in r.tables["a"].collect()] == [("b", 5)] and list((tmp_path / "o").glob("*.arrows"))


def test_arrays_and_values(spark):
    out = run_script(spark, """
arreglo v = [1, 2, 3, 4];
arreglo z = ceros(2, 3);
suma(v); media(v); mediana(v); percentil(v, 75, conservar dimensiones); suma(z, eje 0); varianza(v);
funcion cuadrado(x) { retornar x * x; }
variable r = cuadrado(3) + 1;
llamar cuadrado(4);
""")
    assert [v for _, v in out.statistics] == [10, 2.5, 2.5, [3.25], [0, 0, 0], 1.25] and out.values == {"r": 10, "cuadrado": 16}


def test_array_statements_of_the_older_form(spark):
    out = run_script(spark, """
array v = [1, 2.5, 3]; array i = [1, 2, 3]; array m = zeros(2, 3); array c = zeros(2, 1); array f = zeros(1, 3);
shape(m); ndim(m); tamaño(m); sum(v); percentile(v, 90); mean(m, 0, true); std(m, 1);
i + 2; i / 2; i * i; c + f; v - 1;
funcion d(x) { retornar x + x; } llama d(2);
""")
    got = dict(out.statistics)
    assert got["forma(m)"] == [2, 3] and got["dimensiones(m)"] == 2 and got["tamano(m)"] == 6 and got["suma(v)"] == 6.5 and abs(got["percentil(v)"] - 2.9) < 1e-12
    assert got["media(m)"] == [[0, 0, 0]] and got["desviacion_estandar(m)"] == [0, 0] and got["i + 2"] == [3, 4, 5] and got["i / 2"] == [0.5, 1, 1.5] and got["i * i"] == [1, 4, 9]
    assert got["c + f"] == [[0, 0, 0], [0, 0, 0]] and got["v - 1"] == [0, 1.5, 2] and out.values == {"d": 4}
    for text, code in (("arreglo a = [9000000000000000000]; a + a;", "OVERFLOW"), ("arreglo a = [1]; arreglo b = [0]; a / b;", "ARGUMENT"), ("suma(zz);", "DATA"), ("arreglo a = [];", "PARSE")):
        with pytest.raises(EngineError) as e:
            run_script(spark, text)
        assert e.value.code == code


def test_sql_typed_and_transactions(spark, tmp_path):
    text = """
sql desde "db" limites filas 100 bytes 65536 tiempo 30000 {
    ejecutar "CREATE TABLE personas (id INTEGER, nombre TEXT, activo BOOLEAN)";
    tabla personas (id entero, nombre texto, activo booleano);
    insertar en personas (id, nombre, activo) valores (1, "Ana", verdadero);
    insertar en personas (id, nombre) valores (2, "x'); DROP TABLE personas; --");
    iniciar;
    actualizar personas establecer nombre = "Eva", activo = falso donde id >= 2;
    confirmar;
    seleccionar nombre, activo de personas donde id == 2;
    consulta "SELECT count(*) AS n, sum(id) AS s FROM personas WHERE id >= ?" con (1);
}"""
    out = run(spark, tmp_path, text).sql
    assert [tuple(r) for r in out[0].collect()] == [("Eva", False)] and tuple(out[1].collect()[0]) == (2, 3)
    with pytest.raises(EngineError):
        run(spark, tmp_path, 'sql desde "db" { tabla personas (id entero, nombre texto, activo booleano); iniciar; actualizar personas establecer id = 9 donde id == 1; }')
    db = Database(spark, str(tmp_path / "db"))
    assert sorted(r.id for r in db.table("personas").collect()) == [1, 2]  # the open transaction left nothing
    db.begin()
    db.execute("DELETE FROM personas WHERE id = 1")
    assert db.table("personas").count() == 1
    db.rollback()
    db.execute("UPDATE personas SET nombre = 'Z' WHERE id = 1")
    db.execute("INSERT INTO personas (id, nombre) VALUES (7, 'q')")
    assert sorted((r.id, r.nombre) for r in db.table("personas").collect()) == [(1, "Z"), (2, "Eva"), (7, "q")]


@pytest.mark.parametrize(("text", "code"), [("ATTACH DATABASE 'x' AS y", "ARGUMENT"), ("DROP TABLE personas", "ARGUMENT"), ("SELECT * FROM nada", "DATA"), ("SELEC 1", "ARGUMENT"), ("SELECT 1 +", "PARSE")])
def test_sql_refusals(spark, tmp_path, text, code):
    with pytest.raises(EngineError) as e:
        Database(spark, str(tmp_path / "x")).query(text)
    assert e.value.code == code


def test_sql_types_and_limits(spark, tmp_path):
    db = Database(spark, str(tmp_path / "y"))
    prog = parse('sql desde "y" { tabla t (a entero, b real); insertar en t (a, b) valores ("x", 1); }').sql[0].statements
    db.execute("CREATE TABLE t (a INTEGER, b REAL)")
    db.declare(prog[0])
    with pytest.raises(EngineError) as e:
        db.insert(prog[1])
    assert e.value.code == "TYPE"
    with pytest.raises(EngineError) as e:
        db.bounded(db.query("SELECT * FROM range(50)"), {"filas": 10, "tiempo": 30000})
    assert e.value.code == "LIMIT"
    with pytest.raises(EngineError) as e:
        db.declare(parse('sql desde "y" { tabla t (a texto, b real); }').sql[0].statements[0])
    assert e.value.code == "TYPE"


@pytest.mark.parametrize("text", [
    ".analisis a { #histograma(\"a,b\") }", ".analisis a { .filtrar { #condicion(\"x > 1\") #condicion(\"x > 2\") } }", ".analisis a { .agrupar { #suma(\"x\") } }", "funcion f(a, a) { }", "funcion f() { } funcion f() { }", ".analisis a {",
    'percentil(v);', '.analisis a { datos desde "f" procesar por lotes de 0 filas }', '.analisis a { .ventas_validas { } }', "sql desde \"x\" limites filas 999999 bytes 1 tiempo 1 { }", "variable x = ;", '.analisis a { agrupar por "k" #spill("p", 1, 2, 3, 4) resumir { suma de "v"; } }', "\"sin fin",
])
def test_parser_refuses(text):
    with pytest.raises(EngineError) as e:
        parse(text)
    assert e.value.code == "PARSE" and e.value.category == "SINTAXIS"


def test_unsupported_actions(spark, tmp_path):
    put(tmp_path, "v.csv", SALES)
    with pytest.raises(EngineError) as e:
        run(spark, tmp_path, '.analisis a { dataset cargar datos("v.csv") .limpiar { #nulos("otro") } }')
    assert e.value.code == "UNSUPPORTED"
    out = run(spark, tmp_path, '.analisis a { dataset cargar datos("v.csv") variable precio numerica .limpiar { #nulos("imputar_media") } .resumir { #percentil("precio,50") #suma("precio") } }')
    assert out.tables["a"].columns == ["precio_suma", "precio_percentil_50"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import lumbre.__main__ as cli

    monkeypatch.setattr(cli, "session", lambda master=None: spark)
    put(tmp_path, "v.csv", SALES)
    at = str(tmp_path / "v.csv")
    assert cli.main(["analizar", at, "fecha", "precio", "cantidad", str(tmp_path / "a.json")]) == 0 and doc(tmp_path, "a.json")["total"] == 72
    assert cli.main(["perfil", at, str(tmp_path / "p.json")]) == 0 and doc(tmp_path, "p.json")["filas"] == 5
    assert cli.main(["inspect", at]) == 0 and "Caracas" in capsys.readouterr().out
    put(tmp_path, "s.txt", "arreglo v = [1, 2]; suma(v);")
    assert cli.main(["run", str(tmp_path / "s.txt")]) == 0 and "suma(v) = 3" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path / "zz.csv")]) == 1 and json.loads(capsys.readouterr().err)["error"] == "IO"
    assert cli.main([]) == 2

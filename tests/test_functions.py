"""Arrays, finance, dates, statistics and functions of scripts."""

import math
from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.functions import arrays as A
from lumbre.functions import calendar, finance, statistics, tensors
from lumbre.functions.user import Program
from lumbre.plans.parser import parse

NAN, INF = float("nan"), float("inf")


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double'}" for k, v in columns.items()))
    return df.select(expression.alias("v")).collect()[0].v


def test_array_statistics(spark):
    a = F.col("a")
    v = [1.0, 2.5, 3.0]
    assert one(spark, A.sum_(a), a=v) == 6.5
    assert abs(one(spark, A.variance(a), a=v) - 0.7222222222222222) < 1e-12 and abs(one(spark, A.std(a), a=v) - 0.8498365855987975) < 1e-12
    assert one(spark, A.median(a), a=v) == 2.5 and abs(one(spark, A.percentile(a, 90), a=v) - 2.9) < 1e-12
    assert math.isnan(one(spark, A.median(a), a=[1.0, NAN])) and math.isnan(one(spark, A.min_(a), a=[1.0, NAN])) and one(spark, A.max_(a), a=v) == 3
    assert one(spark, A.percentile(a, 75), a=[1.0, 2.0, 3.0, 4.0]) == 3.25 and one(spark, A.percentile(a, 50), a=[]) is None
    assert one(spark, A.percentile(a, 50), a=[INF, INF]) == INF
    with pytest.raises(Exception, match="NaN or empty"):
        one(spark, A.argmin(a), a=[NAN])


def test_array_arithmetic(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, A.add(a, b), a=[1.0, 2.0], b=[3.0, 4.0]) == [4, 6]
    assert one(spark, A.multiply(a, b), a=[1.0, 2.0], b=[10.0]) == [10, 20] and one(spark, A.subtract(a, b), a=[1.0], b=[10.0, 20.0]) == [-9, -19]
    assert one(spark, A.less(a, b), a=[1.0, NAN, 3.0], b=[2.0, 2.0, NAN]) == [True, False, False]
    for bad in (A.add(a, b), A.divide(a, b)):
        with pytest.raises(Exception, match="shapes"):
            one(spark, bad, a=[1.0, 2.0, 3.0], b=[1.0, 2.0])
    with pytest.raises(Exception, match="(?i)zero"):
        one(spark, A.divide(a, b), a=[1.0], b=[0.0])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-9, 9).map(float), max_size=7), st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.integers(-9, 9)), st.sampled_from([-3, -2, -1, 1, 2, 3]))
def test_slices_are_pythons(spark, values, start, stop, step):
    assert one(spark, A.slice_(F.col("a"), start, stop, step), a=values) == values[start:stop:step]


def test_array_shapes(spark):
    a = F.col("a")
    m = A.reshape(a, 2, 3)
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert one(spark, m, a=v) == [[1, 2, 3], [4, 5, 6]] and one(spark, A.transpose(m), a=v) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, A.along(m, 0, A.sum_), a=v) == [5, 7, 9] and one(spark, A.along(m, 1, A.mean, keep=True), a=v) == [[2], [5]]
    assert one(spark, A.shape(m, 2), a=v) == [2, 3] and one(spark, A.zeros(2, 2), a=v) == [[0, 0], [0, 0]] and one(spark, A.flatten(m), a=v) == v
    assert one(spark, A.broadcast_rows(a, 2), a=[1.0]) == [[1], [1]] and one(spark, A.isfinite(a), a=[1.0, INF, NAN]) == [True, False, False] and one(spark, A.isnan(a), a=[1.0, NAN]) == [False, True]
    assert one(spark, A.nonzero(a), a=[0.0, 5.0, 0.0, 1.0]) == [1, 3] and one(spark, A.cast(a, "int"), a=[1.9, -1.9]) == [1, -1]
    with pytest.raises(Exception, match="shapes"):
        one(spark, A.reshape(a, 2, 2), a=v)
    with pytest.raises(Exception, match="(?i)cast|overflow"):
        one(spark, A.cast(a, "int"), a=[1e12])


def test_tensors():
    a = tensors.zeros(2, 3)
    assert tensors.add(a, tensors.zeros(1, 3)).shape == (2, 3) and tensors.add(a, tensors.zeros(2, 1)).shape == (2, 3)
    i = np.array([1, 2, 3])
    assert tensors.multiply(i, np.array([4, 5, 6])).dtype == np.int64 and tensors.divide(i, i).dtype == np.float64
    for f, code in ((lambda: tensors.add(np.array([9 * 10**18]), np.array([9 * 10**18])), "OVERFLOW"), (lambda: tensors.divide(np.array([1]), np.array([0])), "ARGUMENT"), (lambda: tensors.add(np.zeros(2), np.zeros(3)), "ARGUMENT"), (lambda: tensors.cast(np.array([NAN]), "int64"), "TYPE"), (lambda: tensors.cast(np.array([300.0]), "int8"), "OVERFLOW"), (lambda: tensors.arg_extreme(np.array([NAN]), True), "ARGUMENT")):
        with pytest.raises(EngineError) as e:
            f()
        assert e.value.code == code
    v = tensors.literal([1, 2, 3, 4])
    assert tensors.reduce(v, "suma") == 10 and tensors.reduce(v, "percentil", 75, keep=True).tolist() == [3.25] and tensors.reduce(v, "varianza") == 1.25
    assert tensors.cast(np.array([1.9, -1.9]), "int32").tolist() == [1, -1] and tensors.arg_extreme(v, False) == 3


def test_decimals():
    p = finance.parse
    assert finance.add(p("12.30"), p("0.70")) == 13 and finance.sub(p("100.00"), p("0.125")) == D("99.875") and finance.mul(p("0.125"), p("2.5")) == D("0.3125")
    assert finance.div(D(1), D(3), 2) == D("0.33") and finance.rounded(p("12.345"), 2) == D("12.35") and finance.rounded(D("2.5"), 0, "half_even") == 2
    assert [finance.rounded(D("-1.5"), 0, m) for m in ("toward_zero", "floor", "ceiling", "half_up")] == [-1, -2, -1, -2]
    assert finance.compound_interest(D(1000), D("0.01"), 2) == D("1020.1") and finance.simple_interest(D(100), D("0.05"), D(2)) == 110
    assert finance.npv([D(-1000), D(1100)], D("0.1")) == 0 and finance.irr([D(-1000), D(1100)], 2) == D("0.10") and finance.compare(D(1), D(2)) == -1
    assert abs(finance.nominal_to_effective(D("0.12"), 12) - D("0.126825030131969720661201")) < D("1e-18")
    assert finance.present_value(D("1020.1"), D("0.01"), 2) == 1000
    for bad in ("1e3", "", "1.1234567890123456789", "x"):
        with pytest.raises(EngineError):
            finance.parse(bad)
    with pytest.raises(EngineError):
        finance.irr([D(1), D(1)])


def test_amortization():
    rows = finance.amortization(D(1000), D("0.01"), 12)
    assert len(rows) == 12 and rows[-1][4] == 0 and sum(r[3] for r in rows) == 1000 and all(r[1] == r[2] + r[3] for r in rows)
    assert finance.annuity_payment(D(1200), D(0), 12) == 100
    assert finance.annuity_payment(D(1000), D("0.01"), 12) == D("88.85") != finance.annuity_payment(D(1000), D("0.01"), 12, compat=True)


def test_finance_columns(spark):
    df = spark.createDataFrame([(D("10.00"), "USD"), (D("5.50"), "USD")], "a decimal(18,2), c string")
    m = finance.money(F.col("a"), F.col("c"))
    assert [r.v.amount for r in df.select(finance.money_add(m, m).alias("v")).collect()] == [20, 11]
    with pytest.raises(Exception, match="currencies"):
        df.select(finance.money_add(m, finance.money(F.col("a"), F.lit("EUR"))).alias("v")).collect()
    with pytest.raises(Exception, match="currency"):
        df.select(finance.money(F.col("a"), F.lit("usd")).alias("v")).collect()
    loans = spark.createDataFrame([(1, 1000.0, 0.01, 3, "2024-01-31")], "id long, p double, r double, n int, d string").withColumn("d", F.to_date("d"))
    out = finance.amortization_rows(loans, ["id"], "p", "r", "n", "d", stick_to_end=True).orderBy("period").collect()
    assert [str(r.due) for r in out] == ["2024-02-29", "2024-03-31", "2024-04-30"] and out[-1].balance == 0
    flows = spark.createDataFrame([(1, 0, "USD"), (1, 0, "USD")], "k long, t long, c string")
    with pytest.raises(Exception, match="series"):
        finance.check_series(flows, ["k"], "t", "c").collect()


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-02-29",)], "t string").select(calendar.parse(F.col("t")).alias("d"))
    d = F.col("d")
    out = df.select(calendar.add_months(d, 1).alias("m"), calendar.add_period(d, "trimestral").alias("q"), calendar.add_period(d, "semestral", 1, True).alias("h"), calendar.add_period(d, "anual").alias("y")).collect()
    assert [str(x) for x in out[0]] == ["2024-02-29", "2024-04-30", "2024-07-31", "2025-01-31"] and str(out[1].y) == "2025-02-28"
    f = spark.range(1).select(calendar.period_fraction(F.lit("2024-01-01").cast("date"), F.lit("2024-04-01").cast("date"), 360).alias("f")).collect()[0].f
    assert f == D("0.252777777777778")


def test_statistics(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(1, 13)], "antes double, despues double")
    w = statistics.wilcoxon(df, "antes", "despues").collect()[0]
    assert (w.pares, w.estadistico) == (12, 78.0) and abs(w.p - math.erfc(39 / math.sqrt(162.5) / math.sqrt(2))) < 1e-12
    assert statistics.correlation(df, "antes", "despues").collect()[0].coeficiente == pytest.approx(1)
    assert statistics.histogram(df, "antes").collect()[0].bins == [3, 2, 2, 2, 3]
    with pytest.raises(EngineError):
        statistics.histogram(df.select(F.lit(1.0).alias("c")), "c")
    with pytest.raises(EngineError):
        statistics.normality(df.limit(7), "antes")
    two = spark.createDataFrame([("A", "1"), ("A", "0"), ("B", "1"), ("B", "0")], "a string, b string")
    chi = statistics.chi_square(two, "a", "b").collect()[0]
    assert (chi.estadistico, chi.gl, chi.celdas_bajas) == (0.0, 1, 4)
    assert statistics.chi_square_p(3.841, 1) == pytest.approx(0.05, abs=0.005)
    ev = spark.createDataFrame([("verdadero", 100.0)], "e string, x double")
    assert statistics.rate(ev, "e", "x", 200000).collect()[0].tasa == 2000
    risk = statistics.risk_measures(5, 95, 2, 98)
    assert risk["rr"] == pytest.approx(2.5) and risk["or"] == pytest.approx(5 * 98 / (95 * 2)) and risk["rr_lower"] < 2.5 < risk["rr_upper"]
    assert statistics.risk_measures(0, 5, 1, 4)["corrected"]
    assert statistics.poisson_normal_interval(2, 100, 200000)[0] == 4000


def test_wilcoxon_ties_both_ways(spark):
    df = spark.createDataFrame([(0.0, d) for d in (1.0, 1.0, -1.0, 2.0, 0.0)], "a double, b double")
    assert statistics.wilcoxon(df, "a", "b").collect()[0].estadistico == 1 + 1 - 1 + 4
    assert statistics.wilcoxon(df, "a", "b", correct=True).collect()[0].estadistico == 2 + 2 + 4


@pytest.mark.parametrize("k", [0, 1, 2, 30, 700, 20046])
def test_poisson_interval_has_its_coverage(k):
    low, high = statistics.poisson_interval(k)
    assert statistics.poisson_cdf(k, high) == pytest.approx(0.025, rel=1e-6)
    assert k == 0 and low == 0 or 1 - statistics.poisson_cdf(k - 1, low) == pytest.approx(0.025, rel=1e-6)


def test_forest():
    f = statistics.ThresholdForest(3, 1).fit([[1, 0], [9, 0], [1, 1], [9, 1]], [0, 1, 0, 1])
    assert f.roots[0][:2] == (0, 5.0) and f.roots[1][0] == 1


SCRIPT = """
funcion factorial(n) { si (n <= 1) { retornar 1; } retornar n * factorial(n - 1); }
función elegir(a, b) { si (a > b) { x = doble(a); } sino { x = b - 1; } retornar x; }
funcion doble(v) { retornar v * 2; }
funcion nada(a) { x = a; }
funcion partir(a) { retornar 1 / a; }
"""


def test_functions(spark):
    p = Program(parse(SCRIPT).functions)
    assert p.call("factorial", 5) == 120 and p.call("elegir", 3, 2) == 6 and p.call("elegir", 1, 2) == 1 and p.call("nada", 3) == 0
    assert p.recursive("factorial") and not p.recursive("elegir")
    for f, code in ((lambda: p.call("partir", 0), "ARGUMENT"), (lambda: p.call("zz"), "DATA"), (lambda: p.call("doble"), "ARGUMENT"), (lambda: p.call("doble", 1e308), "OVERFLOW"), (lambda: p.call("factorial", 5000), "LIMIT")):
        with pytest.raises(EngineError) as e:
            f()
        assert e.value.code == code
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r.v for r in df.select(p.column("elegir")(F.col("a"), F.col("b")).alias("v")).collect()] == [6, 1, None]
    assert [r.v for r in df.select(p.column("factorial")(F.col("a")).alias("v")).collect()] == [6, 1, None]
    with pytest.raises(Exception, match="division by zero"):
        df.select(p.column("partir")(F.col("b") - 2)).collect()

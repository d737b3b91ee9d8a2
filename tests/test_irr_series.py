"""irr_series against a bisection in floats."""

from collections import defaultdict

from lumbre import queries as Q


def test_irr_series_equals_bisection(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet").collect()
    flows = {r.p_partkey: [-100 * float(r.p_retailprice)] for r in t("part")}
    orders = defaultdict(list)
    for r in sorted(t("orders"), key=lambda r: r.o_orderkey):
        orders[r.o_custkey].append(float(r.o_totalprice))
    for k, v in orders.items():
        flows.setdefault(k, []).extend(v)

    def value(v, rate):
        return sum(x / (1 + rate) ** i for i, x in enumerate(v))

    got = {r.p_partkey: r.irr for r in Q.queries()["irr_series"](spark, sf).collect()}
    assert got.keys() == flows.keys()
    rates = set()
    for k, v in flows.items():
        low, high = -0.999999, 10.0
        if (value(v, low) > 0) == (value(v, high) > 0):
            assert got[k] is None
            continue
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if (value(v, middle) > 0) == (value(v, low) > 0) else (low, middle)
        assert abs(got[k] - low) < 1e-5
        rates.add(got[k])
    assert len(rates) > 50 and max(len(v) for v in flows.values()) > 10


def test_rates_equal_exact_bisection():
    """Series by the hundred in doubles, digit by digit as one by one in decimals; roots on bounds, several roots and none."""
    import random
    import time
    from decimal import Decimal

    import numpy as np

    from lumbre.errors import EngineError
    from lumbre.functions import finance

    def exact(values):
        try:
            return float(finance.irr([Decimal(str(v)) for v in values])) + 0.0
        except EngineError:
            return None

    rnd = random.Random(5)
    price = lambda low, high: round(rnd.uniform(low, high), 2)
    for size in (1, 2, 3, 8, 60, 400):
        rows = [[-100 * price(900, 2000)] + [price(1000, 400000) for _ in range(size - 1)] for _ in range(30)]
        rows += [[price(-1000, 1000) for _ in range(size)] for _ in range(10)] + [[float(rnd.choice([-100, 0, 100, 110, 1100])) for _ in range(size)] for _ in range(10)]
        rows += [[-100.0, *[0.0] * (size - 2), 100.0 * k] for k in (1, 1.5, 11) if size > 1]
        got = finance._rates(np.array(rows), lambda i: [Decimal(str(v)) for v in rows[i]], 12)
        assert [None if g != g else repr(float(g)) for g in got] == [None if w is None else repr(w) for w in map(exact, rows)]

    def refuse(i):
        raise AssertionError("solved one by one")

    began = time.process_time()
    many = np.array([[-1000.0, *(300.0 + (k * 7 + i * 13) % 90 for i in range(9))] for k in range(90)])
    assert np.isfinite(finance._rates(many, refuse, 9)).all() and time.process_time() - began < 5


def test_series_come_in_their_order(spark):
    from decimal import Decimal

    from lumbre.functions import finance

    rows = [(1, 2, 121.0), (1, 1, -100.0), (1, None, 0.0), (2, 1, 5.0), (3, 1, -100.0), (3, 2, 100.0), (None, 1, -1.0), (None, 3, 2.0)]
    for kind, cast in (("double", float), ("decimal(9,2)", lambda v: Decimal(str(v))), ("float", float)):
        df = spark.createDataFrame([(k, i, cast(v)) for k, i, v in rows], f"k int, i int, f {kind}")
        got = {r.k: r.irr for r in finance.series_irr(df, ["k"], "i", "f").collect()}
        assert got == {1: 0.21, 2: None, 3: 0.0, None: 1.0} and repr(got[3]) == "0.0"

"""Every query of the engine against its SQL."""

import pytest
from oracle import check, connection

from lumbre import queries as Q

CORE, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    check(CORE[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as E

    assert E.entry(spark).columns[0] == "l_returnflag"
    assert set(E.oracle_sql()) <= set(E.queries())


def test_filter_reaches_the_scan(spark, sf):
    plan = CORE["filter_gt"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan and "l_extendedprice" not in plan


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import lumbre.queries, lumbre.plans.runner, lumbre.sources.sqlite, sys; assert not any(m.startswith('lumbre.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)

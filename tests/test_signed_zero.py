"""What rounds to zero keeps its sign, as in the SQL."""

import duckdb
import pytest

from lumbre import queries as Q


def flat(v):
    return [y for x in v for y in flat(x)] if isinstance(v, (list, tuple)) else [v]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Columns, rows and single values that round to -0.0, to 0.0, and one NaN-free row of common values."""
    at = str(tmp_path_factory.mktemp("vectors"))
    rows = [(1, [-1e-8] * 64), (2, [1e-8] * 64), (3, [(-1) ** i * i / 7 - 1e-9 for i in range(64)]), (4, [-0.0] * 64), (5, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def same_to_the_sign(spark, at, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    got = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = {r[0]: [repr(x) for x in flat(r)] for r in got.fetchall()}
    have = {r[0]: [repr(x) for x in flat(tuple(r))] for r in Q.queries()[name](spark, at).select(*names).collect()}
    assert have == want


def test_axis_mean(spark, vectors):
    same_to_the_sign(spark, vectors, "array_axis_mean")


def test_axis_median(spark, vectors):
    same_to_the_sign(spark, vectors, "array_axis_median")


def test_rounded_columns_and_groups(spark):
    df = Q.rounded(spark.createDataFrame([(1, -1e-9, 7), (2, 1.23456, 8), (3, None, 9), (4, float("nan"), 1), (5, -2.55555, 1)], "k int, v double, i int"), "v", "i")
    assert dict(df.dtypes) == {"k": "int", "v": "double", "i": "int"}
    assert [repr(r.v) for r in df.orderBy("k").collect()] == ["-0.0", "1.2346", "None", "nan", "-2.5556"]


def test_broadcast(spark, vectors):
    same_to_the_sign(spark, vectors, "array_broadcast")


def test_matrix(spark, vectors):
    same_to_the_sign(spark, vectors, "array_matrix")

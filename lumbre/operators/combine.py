"""Joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.operators.project import col, require

# Names of the join kinds, in the script's language and in Spark's.
KINDS = {"interior": "inner", "izquierda": "left", "derecha": "right", "completa": "full", "inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "left_semi": "left_semi", "left_anti": "left_anti"}
HINTS = {"broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}


def right_names(left: list[str], right: list[str], suffix: str = "_right") -> list[str]:
    """Names of the right columns beside the left: x, or x_right, or x_right2, x_right3, ..."""
    taken, out = set(left), []
    for name in right:
        new, k = name, 1
        while new in taken:
            new = f"{name}{suffix}" if k == 1 else f"{name}{suffix}{k}"
            k += 1
        taken.add(new)
        out.append(new)
    return out


def _same_type(a: T.DataType, b: T.DataType) -> bool:
    return a == b


def join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str] | None = None, how: str = "inner", hint: str | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Equi-join. Null keys never match; NaN equals NaN and -0.0 equals 0.0; key types must be equal.

    The result has all left columns, then all right ones (also the keys), renamed where names clash. Catalyst and
    adaptive execution choose the strategy from sizes and split skewed keys; `hint` overrides. max_rows, max_bytes: a
    result beyond either raises OVERFLOW before it is formed, as `join_size` finds.
    """
    right_keys = right_keys or left_keys
    require(left, *left_keys)
    require(right, *right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise EngineError("ARGUMENT", "as many left keys as right keys are needed")
    for a, b in zip(left_keys, right_keys):
        if not _same_type(left.schema[a].dataType, right.schema[b].dataType):
            raise EngineError("TYPE", f"key {a} is {left.schema[a].dataType.simpleString()} on the left, {right.schema[b].dataType.simpleString()} on the right")
    kind = KINDS.get(how)
    if kind is None:
        raise EngineError("ARGUMENT", f"unknown join {how}")
    if max_rows is not None or max_bytes is not None:
        rows, size = join_size(left, right, left_keys, right_keys, how)
        if max_rows is not None and rows > max_rows:
            raise EngineError("OVERFLOW", f"{rows} rows, more than {max_rows}")
        if max_bytes is not None and size > max_bytes:
            raise EngineError("OVERFLOW", f"{size} bytes, more than {max_bytes}")
    names = right_names(left.columns, right.columns)
    renamed = right.toDF(*names)
    new = dict(zip(right.columns, names))
    if hint:
        renamed = renamed.hint(HINTS.get(hint, hint))
    on = reduce(Column.__and__, (left[f"`{a}`"] == renamed[f"`{new[b]}`"] for a, b in zip(left_keys, right_keys)))
    return left.join(renamed, on, kind)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: texts and binaries by their length, numbers by their width, null as nothing."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c).cast("long")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c))).cast("long")
        else:
            size = F.lit({"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(f.dataType.simpleString(), 8)).cast("long")
        out = out + F.when(c.isNull(), F.lit(0).cast("long")).otherwise(size)
    return out


def join_size(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str] | None = None, how: str = "inner") -> tuple[int, int]:
    """(rows, bytes) of a join's result, from the rows and bytes of each key: no pair of rows is formed."""
    right_keys = right_keys or left_keys
    kind = KINDS[how]

    def side(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.select(*(col(k).alias(f"_k{i}") for i, k in enumerate(keys)), row_bytes(df).cast("double").alias("_b")).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.count(F.lit(1)).cast("double").alias(f"n{name}"), F.sum("_b").alias(f"b{name}"))

    both = side(left, left_keys, "l").join(side(right, right_keys, "r"), [f"_k{i}" for i in range(len(left_keys))], "full")
    nl, nr, bl, br = (F.coalesce(c, F.lit(0.0)) for c in ("nl", "nr", "bl", "br"))
    met = (nl > 0) & (nr > 0)
    alone = {"inner": F.lit(False), "left": nr == 0, "right": nl == 0, "full": ~met, "left_semi": F.lit(False), "left_anti": nr == 0}[kind]
    pairs, size = ((nl, bl) if kind == "left_semi" else (F.lit(0.0), F.lit(0.0)) if kind == "left_anti" else (nl * nr, bl * nr + br * nl))
    r = both.agg(F.sum(F.when(met, pairs).when(alone, nl + nr).otherwise(0.0)).alias("n"), F.sum(F.when(met, size).when(alone, bl + br).otherwise(0.0)).alias("b")).collect()[0]
    return int(r["n"] or 0), int(r["b"] or 0)


def guarded(df: DataFrame, max_rows: int) -> DataFrame:
    """df; raises OVERFLOW if it has more rows. Counts before anything is published."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise EngineError("OVERFLOW", f"more than {max_rows} rows")
    return df


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; with equalities in it Spark hashes on those, else one side should be small."""
    return left.join(right, on, KINDS.get(how, how))


def cross_join(left: DataFrame, right: DataFrame, max_rows: int = 1_000_000_000) -> DataFrame:
    """All pairs. Their number is known before any is formed; more than max_rows raise OVERFLOW."""
    rows = left.count() * right.count()
    if rows > max_rows:
        raise EngineError("OVERFLOW", f"{rows} rows, more than {max_rows}")
    return left.crossJoin(right.toDF(*right_names(left.columns, right.columns)))


def band_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, width: float) -> DataFrame:
    """Pairs with |left - right| <= width, by cells of that width: an equi-join instead of a nested loop."""
    names = right_names(left.columns, right.columns)
    r = right.toDF(*names)
    rc = dict(zip(right.columns, names))[right_col]
    cell = F.floor(F.col(left_col) / width)
    probes = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = probes.join(r.withColumn("_rcell", F.floor(F.col(rc) / width)), F.col("_cell") == F.col("_rcell"))
    return met.filter(F.abs(F.col(left_col) - F.col(rc)) <= width).drop("_cell", "_rcell")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its keys that is latest at or before its time.

    Both sides go through one shuffle and one sort by key and time, and the last right row is carried forward: no pair
    of rows is formed.
    """
    from pyspark.sql import Window

    carried = F.struct(*(col(v) for v in values))
    a = left.select(F.struct("*").alias("_left"), *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    names = right_names(left.columns, values)
    return both.select("_left.*", *(F.col("_right").getField(v).alias(n) for v, n in zip(values, names)))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)

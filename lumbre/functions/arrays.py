"""Kernels over array columns (one-dimensional, or nested for matrices), as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def _check(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def _elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Arrays of one length, or one of length 1 that is repeated (broadcasting)."""
    n, m = F.size(a), F.size(b)
    out = F.when(n == m, F.zip_with(a, b, op)).when(m == 1, F.transform(a, lambda x: op(x, F.get(b, F.lit(0))))).when(n == 1, F.transform(b, lambda y: op(F.get(a, F.lit(0)), y)))
    return F.when((n == m) | (m == 1) | (n == 1), out).otherwise(F.raise_error(F.lit("ARGUMENT: shapes do not match")))


def finite(x: Column) -> Column:
    """x; a result that is not finite raises OVERFLOW."""
    return F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == INF), F.raise_error(F.lit("OVERFLOW: not finite"))).otherwise(x)


def add(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Real division; a zero divisor raises."""
    return _elementwise(a, b, lambda x, y: x.cast("double") / y.cast("double"))


def _ordered(x: Column, y: Column, result: Column) -> Column:
    """Comparisons with NaN are false."""
    return result & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))


def equal(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: _ordered(x, y, x == y))


def less(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: _ordered(x, y, x < y))


def greater(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: _ordered(x, y, x > y))


def greater_than(a: Column, literal: float) -> Column:
    return F.transform(a, lambda x: _ordered(x, F.lit(literal), x > F.lit(literal)))


def isnan(a: Column) -> Column:
    return F.transform(a, F.isnan)


def isfinite(a: Column) -> Column:
    return F.transform(a, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < INF))


def where(condition: Column, x: Column, y: Column) -> Column:
    return F.transform(F.arrays_zip(condition.alias("c"), x.alias("x"), y.alias("y")), lambda z: F.when(z["c"], z["x"]).otherwise(z["y"]))


def mask(a: Column, m: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(a.alias("a"), m.alias("m")), lambda z: z["m"]), lambda z: z["a"])


def nonzero(a: Column) -> Column:
    """Places of the values that are not zero (or are true), from 0."""
    flags = F.transform(a, lambda x, i: F.when(x.cast("double") != 0, i.cast("long")))
    return F.filter(flags, lambda i: i.isNotNull())


def cast(a: Column, element: str) -> Column:
    """Element type by Spark's name; a real number loses its fraction, what does not fit raises."""
    return a.cast(f"array<{element}>")


def sum_(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def sum_long(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def prod(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    return sum_(a) / F.nullif(F.size(a), F.lit(0))


def _nan_or(a: Column, value: Column) -> Column:
    return F.when(F.exists(a, lambda x: F.isnan(x.cast("double"))), F.lit(NAN)).otherwise(value)


def min_(a: Column) -> Column:
    """NaN propagates, here and in max."""
    return _nan_or(a, F.array_min(a))


def max_(a: Column) -> Column:
    return _nan_or(a, F.array_max(a))


def variance(a: Column) -> Column:
    """Of the population, in two passes."""
    n = F.nullif(F.size(a), F.lit(0))
    moved = F.aggregate(a, F.struct(mean(a).alias("m"), F.lit(0.0).alias("s")), lambda z, x: F.struct(z["m"].alias("m"), (z["s"] + (x - z["m"]) * (x - z["m"])).alias("s")), lambda z: z["s"])
    return moved / n


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def percentile(a: Column, p: float) -> Column:
    """Linear between the values around the place (n - 1) p / 100; NaN if there is one, null of an empty array."""
    s = F.array_sort(a.cast("array<double>"))
    at = (F.size(a) - 1) * F.lit(p / 100)
    low = F.floor(at).cast("int")
    below, above = F.get(s, low), F.get(s, F.least(low + 1, F.size(a) - 1))
    part = at - low
    return F.when(F.size(a) > 0, _nan_or(a, F.when((part == 0) | (below == above), below).otherwise(below + (above - below) * part)))


def median(a: Column) -> Column:
    return percentile(a, 50)


def _no_nan(a: Column, value: Column) -> Column:
    return F.when(F.exists(a, lambda x: F.isnan(x.cast("double"))) | (F.size(a) == 0), F.raise_error(F.lit("ARGUMENT: NaN or empty"))).otherwise(value)


def argmin(a: Column) -> Column:
    """Place of the first least value, from 0."""
    return _no_nan(a, F.array_position(a, F.array_min(a)) - 1)


def argmax(a: Column) -> Column:
    return _no_nan(a, F.array_position(a, F.array_max(a)) - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def zeros(*shape: int) -> Column:
    out = F.lit(0.0)
    for n in reversed(shape):
        out = F.array_repeat(out, n)
    return out


def reshape(a: Column, rows: int, columns: int) -> Column:
    """A matrix of the flat array's values, row by row."""
    return _check(F.size(a) == rows * columns, "ARGUMENT: shapes do not match", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * columns + 1, columns)))


def flatten(m: Column) -> Column:
    return F.flatten(m)


def slice_(a: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """As a Python slice, negative places and steps included."""
    if step == 0:
        raise ValueError("step 0")
    n = F.size(a)
    at = lambda v, default: default if v is None else (F.greatest(F.lit(0 if step > 0 else -1), n + v) if v < 0 else F.least(F.lit(v), n if step > 0 else n - 1))
    low, high = (at(start, F.lit(0)), at(stop, n)) if step > 0 else (at(stop, F.lit(-1)), at(start, n - 1))
    if step > 0:
        return F.filter(a, lambda x, i: (i >= low) & (i < high) & ((i - low) % step == 0))
    return F.reverse(F.filter(a, lambda x, i: (i > low) & (i <= high) & ((high - i) % -step == 0)))


def transpose(m: Column) -> Column:
    width = F.size(F.get(m, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))).otherwise(m)


def broadcast_rows(a: Column, rows: int) -> Column:
    return F.array_repeat(a, rows)


def add_rows(a: Column, b: Column) -> Column:
    """The sum of two matrices of one shape, or whose rows have length 1 in one of them."""
    return F.zip_with(a, b, add)


def along(m: Column, axis: int, kernel: Callable[[Column], Column], keep: bool = False) -> Column:
    """A reduction of a matrix along an axis; keep leaves that axis with length 1."""
    if axis == 1:
        out = F.transform(m, kernel)
        return F.transform(out, lambda x: F.array(x)) if keep else out
    out = F.transform(transpose(m), kernel)
    return F.array(out) if keep else out


def shape(a: Column, dimensions: int = 1) -> Column:
    sizes, at = [], a
    for _ in range(dimensions):
        sizes.append(F.size(at))
        at = F.get(at, F.lit(0))
    return F.array(*sizes)

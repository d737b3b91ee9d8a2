"""Exact percentiles of a column of any size.

The aggregate function keeps every distinct value of a group in one task's memory. Here each pass counts the values in
1,024 equal cells of the range that holds the wanted rank and goes on with the cell that does; the cells' own least and
greatest values are the next range, so a few passes suffice, and what moves is one row per task and cell. When no more
than `few` values are left, their distinct ones are fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.errors import EngineError
from lumbre.operators.project import col, require

CELLS = 1024


def _value_at(values: DataFrame, rank: int, n: int, lo: float, hi: float, few: int) -> float:
    """The value with `rank` smaller-or-earlier ones (from 0) among the n values in [lo, hi]."""
    v = F.col("v")
    while lo < hi and n > few:
        width = (hi - lo) / CELLS
        cell = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        cells = values.filter((v >= lo) & (v <= hi)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("cell").collect()
        for c in cells:
            if rank < c["n"]:
                break
            rank -= c["n"]
        if (c["lo"], c["hi"], c["n"]) == (lo, hi, n):
            break  # neighbouring numbers: no cell between them
        lo, hi, n = c["lo"], c["hi"], c["n"]
    if lo == hi:
        return lo
    for r in values.filter((v >= lo) & (v <= hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect():
        if rank < r["n"]:
            return r["v"]
        rank -= r["n"]
    raise EngineError("INTERNAL", "the column changed between passes")


def exact_percentiles(df: DataFrame, column: str, percentages: list[float], few: int = 100_000) -> DataFrame:
    """(p, value): linear between the values around the place (n - 1) p / 100; null if there are none, NaN if one is."""
    require(df, column)
    if any(not 0 <= p <= 100 for p in percentages):
        raise EngineError("ARGUMENT", "a percentage lies between 0 and 100")
    values = df.select(col(column).cast("double").alias("v")).filter("v is not null")
    s = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()[0]
    out: list[tuple[float, float | None]] = []
    known: dict[int, float] = {}
    for p in percentages:
        if not s["n"] or s["hi"] != s["hi"]:
            out.append((float(p), s["hi"]))
            continue
        at = (s["n"] - 1) * p / 100
        low, part = int(at), at - int(at)
        for rank in {low, low + 1} if part else {low}:
            if rank not in known:
                known[rank] = _value_at(values, rank, s["n"], s["lo"], s["hi"], few)
        out.append((float(p), known[low] + (known[low + 1] - known[low]) * part if part else known[low]))
    return df.sparkSession.createDataFrame(out, "p double, value double")

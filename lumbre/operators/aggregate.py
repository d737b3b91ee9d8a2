"""Grouped and global aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.operators.project import col, require
from lumbre.operators.quantile import exact_percentiles

#: The basic aggregates come before the others in a summary.
BASIC = ("suma", "media", "minimo", "maximo", "conteo")
ADVANCED = ("varianza", "desviacion_estandar", "mediana", "percentil")
NAN = float("nan")


@dataclass(frozen=True)
class Metric:
    """An operation on a column; percentil carries its p, 0 to 100."""

    op: str
    column: str
    p: float | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        if self.name:
            return self.name
        return f"{self.column}_{self.op}" + (f"_{self.p:g}" if self.op == "percentil" else "")


def _extreme(c: Column, kind: T.DataType, low: bool) -> Column:
    """min or max; for floats NaN propagates in both, where Spark has it as the largest value."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) and low:
        return F.when(F.max(F.isnan(c)), F.lit(NAN)).otherwise(F.min(c))
    return F.min(c) if low else F.max(c)


def expression(df: DataFrame, m: Metric) -> Column:
    require(df, m.column)
    c, kind = col(m.column), df.schema[m.column].dataType
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    if m.op != "conteo" and not numeric and m.op not in ("minimo", "maximo"):
        raise EngineError("TYPE", f"{m.op} needs a number, {m.column} is {kind.simpleString()}")
    if isinstance(kind, T.BooleanType) and m.op not in ("conteo", "minimo", "maximo"):
        c = c.cast("long")
    if m.op == "conteo":
        return F.count(c)
    if m.op == "suma":
        return F.sum(c)
    if m.op == "media":
        return F.avg(c)
    if m.op in ("minimo", "maximo"):
        return _extreme(c, kind, m.op == "minimo")
    if m.op == "varianza":
        return F.var_pop(c)
    if m.op == "desviacion_estandar":
        return F.stddev_pop(c)
    if m.op == "mediana":
        return F.median(c)
    if m.op == "percentil":
        if m.p is None or not 0 <= m.p <= 100:
            raise EngineError("ARGUMENT", "percentil needs p from 0 to 100")
        return F.percentile(c, F.lit(m.p / 100))
    raise EngineError("ARGUMENT", f"unknown aggregate {m.op}")


def _labelled(df: DataFrame, metrics: list[Metric], taken: list[str]) -> list[Column]:
    names = [*taken, *(m.label for m in metrics)]
    if len(set(names)) != len(names):
        raise EngineError("DATA", "two output columns share a name")
    return [expression(df, m).alias(m.label) for m in metrics]


QUANTILES = ("mediana", "percentil")


def _part(m: Metric) -> float:
    return 0.5 if m.op == "mediana" else m.p / 100


def _group_quantiles(df: DataFrame, keys: list[str], column: str, metrics: list[Metric]) -> DataFrame:
    """Keys (as _k0, _k1, ...) and the quantiles of a column, linear between neighbours, NaN if a value is.

    A group's equal values are one row before they are sorted, and the sort spills: no task holds a group in memory.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    v = col(column).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(*(col(k).alias(n) for k, n in zip(keys, named)), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*named)
    ranked = counts.withColumn("_to", F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))
    out, at = [], lambda m: (F.col("_all") - 1) * F.lit(_part(m))
    for i, m in enumerate(metrics):
        out += [F.min(F.when(F.col("_to") > F.floor(at(m)), F.col("_v"))).alias(f"_lo{i}"), F.min(F.when(F.col("_to") > F.ceil(at(m)), F.col("_v"))).alias(f"_hi{i}"), F.first(at(m) - F.floor(at(m))).alias(f"_part{i}")]
    found = ranked.groupBy(*named).agg(*out, F.max(F.isnan("_v")).alias("_nan"))
    value = lambda i: F.when(F.col("_nan"), F.lit(NAN)).when(F.col(f"_part{i}") > 0, F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).otherwise(F.col(f"_lo{i}"))
    return found.select(*named, *(value(i).alias(m.label) for i, m in enumerate(metrics)))


def grouped(df: DataFrame, keys: list[str], metrics: list[Metric], first_seen: str | None = None) -> DataFrame:
    """Group by keys: null is a group, all NaN are one. Partial sums are formed map-side; quantiles come from sorted counts.

    first_seen: a row id; groups then come in the order of their first row.
    """
    require(df, *keys)
    if not keys or not metrics:
        raise EngineError("ARGUMENT", "keys and aggregates are needed")
    made = _labelled(df, metrics, keys)
    out = [c for c, m in zip(made, metrics) if m.op not in QUANTILES]
    if first_seen:
        out.append(F.min(col(first_seen)).alias("_first"))
    g = df.groupBy(*(col(k) for k in keys))
    result = g.agg(*(out or [F.count(F.lit(1)).alias("_rows")]))
    for column in dict.fromkeys(m.column for m in metrics if m.op in QUANTILES):
        found = _group_quantiles(df, keys, column, [m for m in metrics if m.op in QUANTILES and m.column == column])
        on = reduce(Column.__and__, (col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        result = result.join(found, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    if first_seen:
        result = result.orderBy("_first")
    return result.select(*(col(k) for k in keys), *(col(m.label) for m in metrics))


def summary(df: DataFrame, metrics: list[Metric]) -> DataFrame:
    """One row, also of an empty table. The basic aggregates stand first.

    Quantiles are found by passes over the column (see `exact_percentiles`), before the row is asked for.
    """
    if not metrics:
        raise EngineError("ARGUMENT", "aggregates are needed")
    metrics = [m for m in metrics if m.op in BASIC] + [m for m in metrics if m.op not in BASIC]
    made = _labelled(df, metrics, [])
    result = df.agg(*([c for c, m in zip(made, metrics) if m.op not in QUANTILES] or [F.count(F.lit(1)).alias("_rows")]))
    for column in dict.fromkeys(m.column for m in metrics if m.op in QUANTILES):
        own = [m for m in metrics if m.op in QUANTILES and m.column == column]
        values = [r["value"] for r in exact_percentiles(df, column, [100 * _part(m) for m in own]).collect()]
        result = result.withColumns({m.label: F.lit(v).cast("double") for m, v in zip(own, values)})
    return result.select(*(col(m.label) for m in metrics))


def grouped_spill(df: DataFrame, key: str, metric: Metric) -> DataFrame:
    """One text key, one aggregate, in bytewise order of the key, null first. Spark spills by itself."""
    return grouped(df, [key], [metric]).orderBy(col(key).asc_nulls_first())


def integer_sum(c: Column, bits: int) -> Column:
    """A sum in the type of its input: beyond its range OVERFLOW is raised."""
    total = F.sum(c.cast("long"))
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.when((total < low) | (total > high), F.raise_error(F.lit("OVERFLOW: sum")).cast("long")).otherwise(total)


def rollup(df: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    return df.rollup(*(col(k) for k in keys)).agg(*_labelled(df, metrics, keys), F.grouping_id().alias("grouping_id"))


def cube(df: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    return df.cube(*(col(k) for k in keys)).agg(*_labelled(df, metrics, keys), F.grouping_id().alias("grouping_id"))


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], metrics: list[Metric]) -> DataFrame:
    return df.groupingSets([[col(k) for k in s] for s in sets], *(col(k) for k in keys)).agg(*_labelled(df, metrics, keys), F.grouping_id().alias("grouping_id"))


def distinct_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("distinct"))


def approximate_distinct(df: DataFrame, keys: list[str], column: str, error: float = 0.02) -> DataFrame:
    """HyperLogLog++: a fixed-size sketch per group instead of its values."""
    return df.groupBy(*keys).agg(F.approx_count_distinct(column, error).alias("distinct"))


def pivot(df: DataFrame, keys: list[str], column: str, values: list, metric: Metric) -> DataFrame:
    """One column per listed value; listing them spares a pass over the data."""
    return df.groupBy(*keys).pivot(column, values).agg(expression(df, metric))


# Mergeable partial states, for aggregates that are kept and merged later (say, day by day).
STATE = "struct<n:long,nulls:long,invalid:long,sum:double,mean:double,m2:double,low:double,high:double,exact:decimal(38,0)>"


def partial_state(df: DataFrame, keys: list[str], column: str, is_text: bool = False) -> DataFrame:
    """keys and `state`: count, nulls, invalid texts, sum, mean, sum of squared deviations, least and greatest; of integer columns also the exact sum."""
    from lumbre.types import safe_number

    require(df, *keys, column)
    raw = col(column)
    exact = F.sum(raw.cast("decimal(20,0)")).cast("decimal(38,0)") if isinstance(df.schema[column].dataType, T.IntegralType) else F.lit(None).cast("decimal(38,0)")
    value = safe_number(raw) if is_text else raw.cast("double")
    missing = (raw.isNull() | (F.trim(raw) == "")) if is_text else raw.isNull()
    n = F.count(value)
    state = F.struct(
        n.alias("n"), F.count_if(missing).alias("nulls"), F.count_if(~missing & value.isNull()).alias("invalid"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias("m2"), F.min(value).alias("low"), F.max(value).alias("high"), exact.alias("exact"),
    )
    return df.groupBy(*(col(k) for k in keys)).agg(state.alias("state"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merged states per key. With the total mean m, the squared deviations add up as m2 + n (mean - m)^2."""
    s = F.col("state")
    n, total = F.sum(s["n"]), F.sum(s["sum"])
    mean = F.when(n > 0, F.sum(s["n"] * s["mean"]) / n).otherwise(0.0)
    # sum n (mean_i - m)^2 = sum n mean_i^2 - N m^2 loses digits; the deviations are taken from the mean itself.
    means = states.groupBy(*(col(k) for k in keys)).agg(mean.alias("_mean"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    means = means.select(*(col(k).alias(f"_{k}") for k in keys), "_mean")
    joined = states.join(means, on, "inner") if keys else states.join(F.broadcast(means))
    merged = F.struct(
        n.alias("n"), F.sum(s["nulls"]).alias("nulls"), F.sum(s["invalid"]).alias("invalid"), total.alias("sum"), F.first("_mean").alias("mean"),
        F.sum(s["m2"] + s["n"] * F.pow(s["mean"] - F.col("_mean"), 2)).alias("m2"), F.min(s["low"]).alias("low"), F.max(s["high"]).alias("high"), F.sum(s["exact"]).cast("decimal(38,0)").alias("exact"),
    )
    return joined.groupBy(*(col(k) for k in keys)).agg(merged.alias("state"))


def final_state(states: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("state")
    some = s["n"] > 0
    return states.select(
        *(col(k) for k in keys), s["n"].alias("conteo"), s["nulls"].alias("nulos"), s["invalid"].alias("invalidos"), F.when(some, s["sum"]).alias("suma"), F.when(some, s["mean"]).alias("media"),
        s["low"].alias("minimo"), s["high"].alias("maximo"), F.when(some, s["m2"] / F.when(some, s["n"])).alias("varianza"), F.when(some, F.when(s["n"] == 1, 0.0).otherwise(s["m2"] / F.when(s["n"] > 1, s["n"] - 1))).alias("varianza_muestral"),
        s["exact"].alias("suma_exacta"),
    )


def encode_states(states: DataFrame) -> DataFrame:
    """The column state as text, for stores without structs; doubles keep all their digits."""
    return states.withColumn("state", F.to_json("state"))


def decode_states(states: DataFrame) -> DataFrame:
    """Text of encode_states back to states; text that is no state raises."""
    back = F.from_json("state", STATE, {"mode": "FAILFAST"})
    return states.withColumn("state", F.when(back["n"].isNull(), F.raise_error(F.lit("DATA: not a state"))).otherwise(back))

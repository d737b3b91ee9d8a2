"""Exact decimal finance.

Sums, differences and simple products are decimal expressions in the JVM. Powers, quotients and rates of return need
more digits than a Spark decimal holds, so they run on Python's decimal in Arrow batches, 50 digits wide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.errors import EngineError

# Names of rounding modes.
MODES = {"toward_zero": ROUND_DOWN, "half_up": ROUND_HALF_UP, "half_even": ROUND_HALF_EVEN, "floor": ROUND_FLOOR, "ceiling": ROUND_CEILING}
TYPE = "decimal(38,18)"
_WIDE = Context(prec=50)
_TEXT = re.compile(r"[+-]?\d+(\.\d{1,18})?|[+-]?\.\d{1,18}")


def parse(text: str) -> Decimal:
    """Digits with at most 18 decimals, no exponent; within 64 bits without its point; trailing zeros go."""
    if not _TEXT.fullmatch(text or ""):
        raise EngineError("PARSE", f"not a decimal: {text!r}")
    value = Decimal(text)
    value = value.quantize(Decimal(1), context=_WIDE) if value == value.to_integral_value() else value.normalize(_WIDE)
    if abs(int(value.scaleb(-value.as_tuple().exponent, _WIDE))) >= 1 << 63:
        raise EngineError("OVERFLOW", text)
    return value


def parse_column(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d{1,18})?|\.\d{1,18})$"), text.try_cast(TYPE))


def rounded(value: Decimal, scale: int, mode: str = "half_up") -> Decimal:
    return value.quantize(Decimal(1).scaleb(-scale), MODES[mode], _WIDE)


def round_column(value: Column, scale: int, mode: str = "half_up") -> Column:
    if mode == "half_up":
        return F.round(value, scale)
    if mode == "half_even":
        return F.bround(value, scale)
    if mode in ("floor", "ceiling"):
        return (F.floor if mode == "floor" else F.ceil)(value, F.lit(scale))
    return F.when(value >= 0, F.floor(value, F.lit(scale))).otherwise(F.ceil(value, F.lit(scale)))


def add(a: Decimal, b: Decimal) -> Decimal:
    return _WIDE.add(a, b)


def sub(a: Decimal, b: Decimal) -> Decimal:
    return _WIDE.subtract(a, b)


def mul(a: Decimal, b: Decimal) -> Decimal:
    return _WIDE.multiply(a, b)


def div(a: Decimal, b: Decimal, scale: int, mode: str = "half_up") -> Decimal:
    if not b:
        raise EngineError("ARGUMENT", "division by zero")
    return rounded(_WIDE.divide(a, b), scale, mode)


def compare(a: Decimal, b: Decimal) -> int:
    return (a > b) - (a < b)


def power(a: Decimal, n: int) -> Decimal:
    return _WIDE.power(a, n)


def future_value(principal: Decimal, rate: Decimal, periods: int) -> Decimal:
    return _WIDE.multiply(principal, power(1 + rate, periods))


compound_interest = future_value


def present_value(amount: Decimal, rate: Decimal, periods: int, scale: int = 18, mode: str = "half_even") -> Decimal:
    return div(amount, power(1 + rate, periods), scale, mode)


def simple_interest(principal: Decimal, rate: Decimal, periods: Decimal) -> Decimal:
    """Principal and interest: P (1 + r n)."""
    return _WIDE.multiply(principal, 1 + _WIDE.multiply(rate, periods))


def nominal_to_effective(nominal: Decimal, per_year: int) -> Decimal:
    return _WIDE.subtract(power(1 + _WIDE.divide(nominal, Decimal(per_year)), per_year), Decimal(1))


def annuity_payment(principal: Decimal, rate: Decimal, periods: int, scale: int = 2, mode: str = "half_up", compat: bool = False) -> Decimal:
    """compat: the discount factor is first rounded to 4 decimals."""
    if periods <= 0:
        raise EngineError("ARGUMENT", "periods")
    if not rate:
        return div(principal, Decimal(periods), scale, mode)
    discount = _WIDE.divide(Decimal(1), power(1 + rate, periods))
    if compat:
        discount = rounded(discount, 4, mode)
    return rounded(_WIDE.divide(_WIDE.multiply(principal, rate), 1 - discount), scale, mode)


def npv(flows: list[Decimal], rate: Decimal) -> Decimal:
    """The flow at place i is divided by (1 + rate)^i; dates play no part."""
    total, factor = Decimal(0), Decimal(1)
    for f in flows:
        total = _WIDE.add(total, _WIDE.divide(f, factor))
        factor = _WIDE.multiply(factor, 1 + rate)
    return total


def irr(flows: list[Decimal], scale: int = 12, steps: int = 96) -> Decimal:
    """Bisection between -0.999999 and 10; a change of sign is needed."""
    low, high = Decimal("-0.999999"), Decimal(10)
    at_low, at_high = npv(flows, low), npv(flows, high)
    for bound, value in ((low, at_low), (high, at_high)):
        if not value:
            return rounded(bound, scale, "half_even")
    if (at_low > 0) == (at_high > 0):
        raise EngineError("DATA", "the flows have no rate of return between the bounds")
    for _ in range(steps):
        middle = _WIDE.divide(_WIDE.add(low, high), Decimal(2))
        value = npv(flows, middle)
        if not value:
            return rounded(middle, scale, "half_even")
        if (value > 0) == (at_low > 0):
            low = middle
        else:
            high = middle
    return rounded(_WIDE.divide(_WIDE.add(low, high), Decimal(2)), scale, "half_even")


def _on_decimals(f: Callable[..., Decimal], returns: str = TYPE) -> Callable[..., Column]:
    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        unit = Decimal(1).scaleb(-18)
        out = []
        for row in zip(*columns):
            if any(v is None or v != v for v in row):
                out.append(None)
                continue
            try:
                out.append(f(*(v if isinstance(v, Decimal) else Decimal(str(v)) for v in row)).quantize(unit, ROUND_HALF_EVEN, _WIDE))
            except InvalidOperation as e:
                raise EngineError("OVERFLOW", "decimal") from e
        return pd.Series(out, dtype=object)

    return run


def future_value_column(principal: Column, rate: Column, periods: Column) -> Column:
    return _on_decimals(lambda p, r, n: future_value(p, r, int(n)))(principal.cast(TYPE), rate.cast(TYPE), periods.cast("int"))


def present_value_column(amount: Column, rate: Column, periods: Column) -> Column:
    return _on_decimals(lambda p, r, n: present_value(p, r, int(n)))(amount.cast(TYPE), rate.cast(TYPE), periods.cast("int"))


def power_column(value: Column, exponent: Column) -> Column:
    return _on_decimals(lambda a, n: power(a, int(n)))(value.cast(TYPE), exponent.cast("int"))


def divide_column(a: Column, b: Column, scale: int, mode: str = "half_up") -> Column:
    return _on_decimals(lambda x, y: div(x, y, scale, mode))(a.cast(TYPE), b.cast(TYPE))


def simple_interest_total(df: DataFrame, principal: str, rate: str, periods: str) -> DataFrame:
    """filas and interes_total: the sum of P (1 + r n) over rows with all three, exact in decimals of the columns' shortest texts."""
    p = F.col(principal).cast("string").cast("decimal(20,4)")
    growth = (F.lit(1).cast("decimal(1,0)") + F.col(rate).cast("string").cast("decimal(12,8)") * F.col(periods).cast("string").cast("decimal(8,2)")).cast("decimal(17,10)")
    return df.agg(F.count(p * growth).alias("filas"), F.sum(p * growth).alias("interes_total"))


def money(amount: Column, currency: Column) -> Column:
    return F.when(currency.rlike("^[A-Z]{3}$"), F.struct(amount.cast(TYPE).alias("amount"), currency.alias("currency"))).otherwise(F.raise_error(F.lit("ARGUMENT: currency")))


def _money(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    same = a["currency"] == b["currency"]
    return F.struct(F.when(same, op(a["amount"], b["amount"])).otherwise(F.raise_error(F.lit("TYPE: currencies differ"))).alias("amount"), a["currency"].alias("currency"))


def money_add(a: Column, b: Column) -> Column:
    return _money(a, b, lambda x, y: x + y)


def money_sub(a: Column, b: Column) -> Column:
    return _money(a, b, lambda x, y: x - y)


def series_npv(flows: DataFrame, keys: list[str], order: str, amount: str, rate: float) -> DataFrame:
    """keys, npv of each series in its order; the place in the series is the exponent."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = flows.withColumn("_at", F.row_number().over(w) - 1)
    return at.groupBy(*keys).agg(F.sum(F.col(amount).cast("double") / F.pow(F.lit(1 + rate), F.col("_at"))).alias("npv"))


_EPS = float(np.finfo(float).eps)
_CELLS = 1 << 18  # flows that are solved at once


def _signs(flows: np.ndarray, growth: np.ndarray) -> np.ndarray:
    """The sign of each row's present value at the rate growth - 1, or 0 where doubles can't tell it.

    Values are multiplied by a positive power of growth, so that no term is beyond its flow.
    """
    small = growth < 1
    terms = np.ones(flows.shape)
    terms[:, 1:] = np.where(small, growth, 1 / growth)[:, None]
    terms = np.multiply.accumulate(terms, axis=1) * np.where(small[:, None], flows[:, ::-1], flows)
    value, unsure = terms.sum(1), _EPS * (4 * flows.shape[1] + 16) * np.abs(terms).sum(1) + 1e-290
    return np.where(np.abs(value) > unsure, np.sign(value), 0)


def _rates(flows: np.ndarray, exact: Callable[[int], list[Decimal]], scale: int) -> np.ndarray:
    """What `irr` gives for each row, by the same bisection in doubles; NaN if there is no rate.

    A sign counts only beyond the rounding error. Where that leaves the last digit of a rate open, the exact flows settle
    it: by their sign at the tie between two digits, or by the whole bisection.
    """
    n, unit = len(flows), 10.0**scale
    out, low, high = np.full(n, np.nan), np.full(n, 1e-6), np.full(n, 11.0)
    with np.errstate(all="ignore"):
        at_low, at_high = _signs(flows, low), _signs(flows, high)
        found = at_low * at_high < 0
        rows = np.flatnonzero(found)
        while len(rows):
            middle = (low[rows] + high[rows]) / 2
            side = _signs(flows[rows], middle) * at_low[rows]
            low[rows[side > 0]], high[rows[side < 0]] = middle[side > 0], middle[side < 0]
            rows = rows[side != 0]
            rows = rows[high[rows] - low[rows] > 4 * _EPS * np.maximum(high[rows], 1)]
    slack = 4 * _EPS * np.maximum(high, 1)
    least, most = np.rint((low - 1 - slack) * unit), np.rint((high - 1 + slack) * unit)
    sure = found & (least == most)
    out[sure] = least[sure] / unit + 0.0
    for i in np.flatnonzero(~sure & ~(at_low * at_high > 0)):
        values = exact(i)
        if found[i] and most[i] == least[i] + 1:
            at_tie = npv(values, (Decimal(least[i]) + Decimal("0.5")).scaleb(-scale))
            if at_tie:
                out[i] = (most[i] if (at_tie > 0) == (at_low[i] > 0) else least[i]) / unit + 0.0
                continue
        try:
            out[i] = float(irr(values, scale)) + 0.0
        except EngineError:
            pass
    return out


def series_irr(flows: DataFrame, keys: list[str], order: str, amount: str, scale: int = 12) -> DataFrame:
    """keys, irr of each series; a series is one task's work, and null if it has no rate."""

    @F.pandas_udf("double")
    def solve(series: pd.Series) -> pd.Series:
        lengths, out = series.map(len).to_numpy(), np.full(len(series), np.nan)
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            for at in range(0, len(same), step := max(1, _CELLS // int(size))):
                rows = same[at : at + step]
                matrix = np.stack([series.iloc[i] for i in rows]).astype(float)
                out[rows] = _rates(matrix, lambda i, rows=rows: [Decimal(str(v)) for v in series.iloc[rows[i]]], scale)
        return pd.Series(out)

    value = F.col(amount)
    if dict(flows.dtypes)[amount] == "float":
        value = value.cast("string").cast("double")  # as its shortest text says
    flow = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), value.alias("value"))
    lists = flows.groupBy(*keys).agg(F.sort_array(F.collect_list(flow)).alias("_flows"))
    return lists.select(*keys, F.nanvl(solve(F.transform("_flows", lambda x: x["value"])), F.lit(None).cast("double")).alias("irr"))


def check_series(flows: DataFrame, keys: list[str], order: str, currency: str) -> DataFrame:
    """flows, if each series has one currency and no two rows of one date; else reading raises."""
    bad = flows.groupBy(*keys).agg(F.count_distinct(currency).alias("c"), F.count(order).alias("n"), F.count_distinct(order).alias("d"))
    ok = bad.select(*keys, F.when((F.col("c") > 1) | (F.col("n") != F.col("d")), F.raise_error(F.lit("DATA: series"))).otherwise(F.lit(True)).alias("_ok"))
    return flows.join(ok, keys).filter("_ok").drop("_ok")


def amortization(principal: Decimal, rate: Decimal, periods: int, payment_scale: int = 2, mode: str = "half_up", compat: bool = False) -> list[tuple[int, Decimal, Decimal, Decimal, Decimal]]:
    """(period, payment, interest, principal, balance); the last payment clears the balance."""
    payment = annuity_payment(principal, rate, periods, payment_scale, mode, compat)
    out, balance = [], principal
    for k in range(1, periods + 1):
        interest = rounded(_WIDE.multiply(balance, rate), payment_scale, mode)
        part = payment - interest if k < periods else balance
        balance = balance - part
        out.append((k, part + interest, interest, part, balance))
    return out


def amortization_rows(loans: DataFrame, keys: list[str], principal: str, rate: str, periods: str, start: str | None = None, months: int = 1, stick_to_end: bool = False) -> DataFrame:
    """One row per loan and period: keys, period, payment, interest, principal_part, balance, and the date if the loan has one."""

    def run(batches):
        for frame in batches:
            rows = []
            for loan in frame.itertuples(index=False):
                for row in amortization(Decimal(str(getattr(loan, principal))), Decimal(str(getattr(loan, rate))), int(getattr(loan, periods))):
                    rows.append((*(getattr(loan, k) for k in keys), *([getattr(loan, start)] if start else []), row[0], *map(float, row[1:])))
            yield pd.DataFrame(rows, columns=[*keys, *(["_start"] if start else []), "period", "payment", "interest", "principal_part", "balance"])

    kinds = dict(loans.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(["_start date"] if start else []), "period int, payment double, interest double, principal_part double, balance double"])
    out = loans.mapInPandas(run, schema)
    if not start:
        return out
    moved = F.add_months("_start", F.col("period") * months)
    day = F.when(F.col("_start") == F.last_day("_start"), F.last_day(moved)).otherwise(moved) if stick_to_end else moved
    return out.withColumn("due", day).drop("_start")

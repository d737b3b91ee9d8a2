"""Dates of the proleptic Gregorian calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumbre.types import iso_date

MONTHS = {"mensual": 1, "trimestral": 3, "semestral": 6, "anual": 12}


def parse(text: Column) -> Column:
    return iso_date(text)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def is_future(day: Column, reference: Column) -> Column:
    return day > reference


def epoch_days(day: Column) -> Column:
    return F.unix_date(day)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def add_months(day: Column, months) -> Column:
    """The day of the month, or the month's last."""
    return F.add_months(day, months)


def add_period(day: Column, period: str, count: int | Column = 1, stick_to_end: bool = False) -> Column:
    """stick_to_end: the last day of a month goes to the last day of a month."""
    moved = F.add_months(day, F.lit(MONTHS[period]) * count)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved) if stick_to_end else moved


def period_fraction(start: Column, end: Column, basis: int = 365) -> Column:
    """ACT/365 or ACT/360, 15 decimals, half-even."""
    # The quotient of (18,20) and (5,0) decimals keeps 26 decimals, enough to round at the 15th.
    days = F.datediff(end, start).cast("decimal(18,0)").cast("decimal(38,20)")
    return F.bround(days / F.lit(basis).cast("decimal(5,0)"), 15)

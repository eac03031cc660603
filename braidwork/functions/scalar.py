"""Scalar functions of the dialect whose results differ from Spark's built-ins of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_(x: Column) -> Column:
    return F.abs(x.cast("double"))


def floor_(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil_(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity; the result is a double."""
    p = float(10**digits)
    return F.floor(x.cast("double") * p + 0.5).cast("double") / p


def power(x: Column, y: Column) -> Column:
    return F.pow(x.cast("double"), y.cast("double"))


def sqrt(x: Column) -> Column:
    """NaN for negative numbers."""
    return F.sqrt(x.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers, truncated; a zero divisor is an error."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return ((a - a % b) / b).cast("bigint")


def mod(a: Column, b: Column) -> Column:
    """Remainder in doubles; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") % b.cast("double"))


def length(x: Column) -> Column:
    return F.length(x)


def substring(s: Column, start: int | Column, n: int | Column | None = None) -> Column:
    """From a position counted from 1; positions outside the text give what part of the range lies inside."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.substr(s, start) if n is None else F.substr(s, start, n if isinstance(n, Column) else F.lit(n))


def concat(*cs: Column) -> Column:
    """Null if any part is null."""
    return F.concat(*cs)

"""Rounding, averages and percentages with one exact recipe.

Decimal sums are exact, so every average is ``sum / count`` with a single
double division and every rounding goes through ``DECIMAL(38,10)``: that
makes the result half-up on the decimal value and independent of row order.
All divisions are ``try_divide`` so an empty denominator gives NULL rather
than an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r(x: ColumnOrName, n: int = 2) -> Column:
    """Half-up rounding to ``n`` places, returned as DOUBLE."""
    return F.round(_c(x).cast("decimal(38,10)"), n).cast("double")


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a / b`` as DOUBLE; NULL when ``b`` is 0 or NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def avg2(c: ColumnOrName, n: int = 2) -> Column:
    """Aggregate: rounded mean of the non-NULL values of ``c``."""
    col = _c(c)
    return r(ratio(F.sum(col), F.count(col)), n)


def wavg2(value_sum: ColumnOrName, weight: ColumnOrName, n: int = 2) -> Column:
    """Aggregate: rounded ``sum(value_sum) / sum(weight)`` (a mean over weighted rows)."""
    return r(ratio(F.sum(_c(value_sum)), F.sum(_c(weight))), n)


def pct(a: ColumnOrName, b: ColumnOrName, n: int = 2) -> Column:
    """Rounded ``100 * a / b``."""
    return r(F.try_divide(_c(a).cast("double") * F.lit(100.0), _c(b).cast("double")), n)


def sum_if(cond: Column, value: ColumnOrName | int = 1) -> Column:
    """Aggregate: ``SUM(CASE WHEN cond THEN value ELSE 0 END)``."""
    v = F.lit(value) if isinstance(value, int) else _c(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def as_dec2(x: ColumnOrName) -> Column:
    """Already-rounded DOUBLE back to an exact decimal, so averaging it is order-free."""
    return _c(x).cast("decimal(18,2)")


def as_dec10(x: ColumnOrName) -> Column:
    """A DOUBLE ratio pinned to ten places before it is summed."""
    return _c(x).cast("decimal(38,10)")

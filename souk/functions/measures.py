"""Aggregate expressions with one rounding rule.

Sums run in decimals, so they do not depend on the order of the rows; a quotient is a
decimal rounded half away from zero, and only the finished column becomes a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souk import model

WEIGHT = "decimal(18,0)"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 2) -> Column:
    return F.round(as_column(c), digits).cast("double")


def money_total(c: Column | str) -> Column:
    return rounded(F.sum(c))


def quotient(num: Column | str, den: Column | str) -> Column:
    """Decimal num / den, NULL when the denominator is 0."""
    return F.try_divide(as_column(num).cast(model.MONEY_SUM), as_column(den).cast(model.COUNT))


def ratio(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    return rounded(quotient(num, den), digits)


def percent(num: Column | str, den: Column | str, digits: int = 1) -> Column:
    return ratio(as_column(num) * 100, den, digits)


def mean(c: Column | str, digits: int = 2) -> Column:
    """Average of the non-null values."""
    return ratio(F.sum(c), F.count(c), digits)


def weighted_mean(c: Column | str, weight: Column | str, digits: int | None = 1) -> Column:
    """Sum of value x weight over sum of weights; an empty weight gives 0."""
    c, weight = as_column(c), as_column(weight)
    q = quotient(F.sum(c.cast(model.MONEY) * weight.cast(WEIGHT)), F.sum(weight))
    q = F.coalesce(q, F.lit(0).cast(model.MONEY_SUM))
    return q.cast("double") if digits is None else rounded(q, digits)



def count_if(flag: Column | str, weight: Column | str | None = None) -> Column:
    """Rows (or weight) where the flag is true; NULL counts as false."""
    hit = as_column(weight) if weight is not None else F.lit(1).cast("bigint")
    return F.sum(F.when(as_column(flag), hit).otherwise(F.lit(0).cast("bigint")))


def safe_share(num: Column, den: Column, digits: int | None = None) -> Column:
    """num / den, or 0 when den is not above zero."""
    q = F.when(den > 0, quotient(num, den)).otherwise(F.lit(0).cast(model.MONEY_SUM))
    return q.cast("double") if digits is None else rounded(q, digits)


def stddev_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares (exact integers)."""
    n, total, squares = (c.cast("decimal(38,0)") for c in (n, total, squares))
    spread = (n * squares - total * total).cast("double")
    pairs = (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(spread / pairs))

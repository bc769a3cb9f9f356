"""Scalar expressions: text cleaning, safe casts, dates, keys and bucketings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from souk import model

# One-argument trim() strips spaces only; raw text may also carry tabs, line ends and NBSP.
_BLANKS = " \t\n\r\x0b\x0c\x85\u00a0\u2028\u2029\ufeff"


def clean(c: Column | str) -> Column:
    """Text without leading or trailing white space of any kind."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(_BLANKS))


def filled(c: Column | str) -> Column:
    """Cleaned text, NULL when empty."""
    return F.nullif(clean(c), F.lit(""))


def to_long(c: Column | str, default: int | None = None) -> Column:
    return _or_default(filled(c).try_cast("bigint"), default)


def to_double(c: Column | str, default: float | None = None) -> Column:
    return _or_default(filled(c).try_cast("double"), default)


def to_money(c: Column | str, default: int | None = None) -> Column:
    return _or_default(filled(c).try_cast(model.MONEY), default, model.MONEY)


def to_timestamp(c: Column | str) -> Column:
    return filled(c).try_cast("timestamp")


def _or_default(c: Column, default, dtype=None) -> Column:
    if default is None:
        return c
    literal = F.lit(default)
    return F.coalesce(c, literal.cast(dtype) if dtype is not None else literal)


def has_text(c: str) -> Column:
    """True when the text is present and not empty; never NULL."""
    return F.coalesce(F.col(c) != "", F.lit(False))


def positive_product(*cols: str) -> Column:
    """Product of the numbers if every one parses and is above zero, else 0.0."""
    numbers = [to_double(c) for c in cols]
    usable = reduce(lambda a, b: a & b, [n > 0 for n in numbers])
    return F.when(usable, reduce(lambda a, b: a * b, numbers)).otherwise(F.lit(0.0))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from `earlier` to `later`, NULL if either is missing."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def date_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def greatest_strict(*cols: str) -> Column:
    """GREATEST that is NULL as soon as one argument is (the built-in skips NULLs)."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return F.when(~missing, F.greatest(*cols))


def make_key(*cols: str) -> Column:
    """Columns joined by '-' into a text key, NULL if any part is NULL."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("-"), F.col(c).cast("string")]
    return F.concat(*parts[1:])


def arrow_label(a: str, b: str) -> Column:
    return F.concat_ws(" → ", a, b)


def megabytes(c: str) -> Column:
    return F.col(c) / F.lit(1024 * 1024)


def bucket(c: Column, steps: Sequence[tuple[float, str]], above: str) -> Column:
    """Label by the first inclusive upper bound the value fits under, else `above`."""
    out = F.lit(above)
    for bound, label in reversed(steps):
        out = F.when(c <= bound, label).otherwise(out)
    return out


def transaction_type(customer_region: str, seller_region: str) -> Column:
    same = F.col(customer_region) == F.col(seller_region)
    return F.when(same, model.SAME_REGION).otherwise(model.CROSS_REGION)


def behaviour_segment(orders: Column) -> Column:
    one, regular, loyal = model.BEHAVIOUR_SEGMENTS
    low, high = model.REGULAR_ORDERS
    return F.when(orders == 1, one).when(orders.between(low, high), regular).when(orders > high, loyal)


def value_segment(spent: Column) -> Column:
    """Spend strictly between the low and the medium bounds belongs to no segment: kept, as NULL."""
    low, medium, high = model.VALUE_SEGMENTS
    start, end = model.MEDIUM_VALUE
    return (F.when(spent <= model.LOW_VALUE_MAX, low).when(spent.between(start, end), medium)
            .when(spent > end, high))


def review_category(key: Column, score: Column) -> Column:
    labels = model.REVIEW_LABELS
    scored = F.when(score == 3, labels["neutral"]).when(score > 3, labels["positive"])
    return F.when(key.isNull(), model.NO_REVIEW).otherwise(F.coalesce(scored, F.lit(labels["negative"])))


def review_timing(days: Column) -> Column:
    return bucket(days, model.REVIEW_TIMING, model.REVIEW_TIMING_ABOVE)


def delivery_speed(days: Column) -> Column:
    return bucket(days, model.DELIVERY_SPEED, model.DELIVERY_SPEED_ABOVE)

"""Date windows, midnight comparisons and calendar-month spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(value: dt.date | str) -> dt.date:
    """Parse ``YYYY-MM-DD`` (or pass a date through)."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


def days_before(as_of: dt.date, days: int) -> dt.date:
    """Date minus N days, computed once on the driver as a literal."""
    return as_date(as_of) - dt.timedelta(days=days)


def in_window(col: str | Column, as_of: dt.date, days: int) -> Column:
    """``as_of - days <= col <= as_of`` (both ends inclusive)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.between(F.lit(days_before(as_of, days)), F.lit(as_date(as_of)))


def in_range(col: str | Column, start: dt.date, end: dt.date, end_inclusive: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    lo = c >= F.lit(as_date(start))
    hi = c <= F.lit(as_date(end)) if end_inclusive else c < F.lit(as_date(end))
    return lo & hi


def midnight(day: dt.date | str) -> Column:
    """A day compared with a timestamp means that day's 00:00."""
    return F.lit(as_date(day)).cast("timestamp_ntz")


def month_start(day: dt.date) -> dt.date:
    d = as_date(day)
    return d.replace(day=1)


def add_months(day: dt.date, n: int) -> dt.date:
    d = as_date(day)
    y, m = divmod(d.month - 1 + n, 12)
    return dt.date(d.year + y, m + 1, 1)


def last_months(as_of: dt.date, n: int) -> tuple[dt.date, dt.date]:
    """First-of-month bounds of the n calendar months ending with as_of's month."""
    last = month_start(as_of)
    return add_months(last, -(n - 1)), last


# The month labels of the reference's charts, January to December.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "June", "July", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_label(col: str | Column) -> Column:
    """Chart label of a date's month (``Jan`` ... ``Dec``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), F.month(c))


def month_key(col: str | Column) -> Column:
    """``'YYYY-M'`` key of a date's month, month without zero padding."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat_ws("-", F.year(c).cast("string"), F.month(c).cast("string"))


def month_spine(keys: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """One row per key and calendar month in [first, last].

    The months are generated per key row (``sequence`` + ``explode``), so
    the spine is a narrow Generate over the key table: no join, no shuffle.
    """
    months = F.sequence(F.lit(month_start(first)), F.lit(month_start(last)), F.expr("INTERVAL 1 MONTH"))
    return keys.select("*", F.explode(months).alias("month_start"))

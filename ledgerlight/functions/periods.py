"""Period and calendar operators.

Two kinds of helpers live here:

* argument maths on Python ``date`` values (report parameters are scalars, so
  they are folded into literals and Catalyst can push them to the scan);
* ``Column`` builders that run per row inside whole-stage codegen.
"""

from __future__ import annotations

import calendar
import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Earliest date the target store accepts (older dates become NULL).
MIN_STORE_DATE = dt.date(1753, 1, 1)

DateLike = dt.date | str


def to_date(value: DateLike) -> dt.date:
    """Coerce an argument (date, or ISO date or date-time text) to a date;
    refuse NULL and text with anything else in it."""
    if value is None:
        raise ValueError("date argument is required")
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(str(value).strip()).date()


def add_months(d: DateLike, months: int) -> dt.date:
    """K1: shift by whole months, clamping the day to the target month's end."""
    d = to_date(d)
    total = d.year * 12 + (d.month - 1) + months
    y, m = divmod(total, 12)
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


class Window(NamedTuple):
    start: dt.date
    end_exclusive: dt.date
    end: dt.date


def parse_dates(start: DateLike, end: DateLike) -> Window:
    """Inclusive user window as a half-open ``[start, end + 1 day)``."""
    s, e = to_date(start), to_date(end)
    if e < s:
        raise ValueError("end_date before start_date")
    return Window(s, e + dt.timedelta(days=1), e)


def previous_period(start: DateLike, end: DateLike) -> Window:
    """K3: both bounds one month back (day clamped)."""
    return parse_dates(add_months(start, -1), add_months(end, -1))


def month_anchors(end: DateLike, months: int = 13) -> tuple[dt.date, dt.date]:
    """K4: first day of the oldest month and first day after the end month."""
    e = to_date(end)
    anchor = dt.date(e.year, e.month, 1)
    return add_months(anchor, -(months - 1)), add_months(anchor, 1)


def lookback_start(start: DateLike, end: DateLike, months: int | None) -> dt.date:
    """K5: start of an N-month look-back ending in ``end``'s month.

    The start day is kept, clamped to that month's length; ``months`` empty or
    0 keeps the given start.
    """
    s, e = to_date(start), to_date(end)
    if not months or months <= 0:
        return s
    first = add_months(e.replace(day=1), 1 - months)
    last = add_months(first, 1) - dt.timedelta(days=1)
    return min(first + dt.timedelta(days=s.day - 1), last)


def same_calendar_month(start: DateLike, end: DateLike) -> bool:
    """K6: both bounds in one calendar month."""
    s, e = to_date(start), to_date(end)
    return (s.year, s.month) == (e.year, e.month)


def default_windows(as_of: DateLike) -> dict[str, dt.date]:
    """Argument defaults computed per call from ``as_of``."""
    a = to_date(as_of)
    first = dt.date(a.year, a.month, 1)
    return {
        "today": a,
        "first_day_of_current_month": first,
        "first_day_of_previous_month": add_months(first, -1),
        "first_day_of_previous_year": dt.date(a.year - 1, 1, 1),
        "six_months_back": add_months(a, -6),
        "twelve_months_back": add_months(a, -12),
        "etl_window_start": a - dt.timedelta(days=365),
    }


# ---------------------------------------------------------------------------
# Column builders
# ---------------------------------------------------------------------------

def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_window(c: str | Column, start: DateLike, end: DateLike) -> Column:
    """``c >= start AND c < end + 1 day``.

    Comparing the raw column (no cast on it) keeps the predicate sargable, so
    parquet gets ``GreaterThanOrEqual``/``LessThan`` pushed down.
    """
    w = parse_dates(start, end)
    c = _col(c)
    return (c >= F.lit(w.start)) & (c < F.lit(w.end_exclusive))


def in_half_open(c: str | Column, start: DateLike, end_exclusive: DateLike) -> Column:
    """``start <= c < end_exclusive`` with the end given exclusive."""
    c = _col(c)
    return (c >= F.lit(to_date(start))) & (c < F.lit(to_date(end_exclusive)))


def day_window_wrap(c: str | Column, start_day: int, end_day: int) -> Column:
    """K-wrap: day of month in ``[s, e]``; when ``s > e`` the window wraps
    (``day >= s OR day <= e``).  Bounds are not clamped to the month end."""
    d = F.dayofmonth(_col(c))
    if start_day <= end_day:
        return d.between(F.lit(start_day), F.lit(end_day))
    return (d >= F.lit(start_day)) | (d <= F.lit(end_day))


def day_window_clamp(c: str | Column, start_day: int, end_day: int) -> Column:
    """K-clamp: both bounds clamped to the month's last day; empty when
    ``s > e`` (after clamping)."""
    c = _col(c)
    d = F.dayofmonth(c)
    eom = F.dayofmonth(F.last_day(c))
    return (d >= F.least(F.lit(start_day), eom)) & (d <= F.least(F.lit(end_day), eom))


def month_start(c: str | Column) -> Column:
    """``DATEFROMPARTS(YEAR(c), MONTH(c), 1)`` as a DATE."""
    return F.trunc(F.to_date(_col(c)), "MM")


def period_key(c: str | Column) -> Column:
    """Month key as ``yyyy-MM`` text (sorts like the month; engine-neutral)."""
    return F.date_format(_col(c), "yyyy-MM")


def month_label(c: str | Column) -> Column:
    """K7: ``Mon yy`` label (``Mar 25``)."""
    return F.date_format(_col(c), "MMM yy")


def clean_date(c: str | Column) -> Column:
    """Text or timestamp to timestamp; unparseable or before
    1753-01-01 becomes NULL (never raises under ANSI)."""
    c = _col(c)
    ts = F.try_to_timestamp(c.cast("string"))
    # Both sides parsed in the session time zone, so the bound is exact.
    floor = F.lit(f"{MIN_STORE_DATE.isoformat()} 00:00:00").cast("timestamp")
    return F.when(ts >= floor, ts)


def ntz_literal(value: dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal from wall-clock text (no time-zone shift)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def month_calendar(spark: SparkSession, first_month: DateLike, last_month: DateLike,
                   name: str = "month") -> DataFrame:
    """K8: one row per month start from ``first_month`` to ``last_month``."""
    a, b = to_date(first_month), to_date(last_month)
    a, b = dt.date(a.year, a.month, 1), dt.date(b.year, b.month, 1)
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(a), F.lit(b), F.expr("INTERVAL 1 MONTH"))).alias(name)
    )


def month_calendar_if_rows(agg: DataFrame, first_month: DateLike, last_month: DateLike,
                           name: str = "month") -> DataFrame:
    """K8 with the empty rule: the months ``first..last`` if ``agg`` has any
    row, else no month.  Built from ``agg``'s one-row count, no join."""
    a, b = to_date(first_month), to_date(last_month)
    a, b = dt.date(a.year, a.month, 1), dt.date(b.year, b.month, 1)
    n = agg.agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") > 0).select(
        F.explode(F.sequence(F.lit(a), F.lit(b), F.expr("INTERVAL 1 MONTH"))).alias(name))


def observed_calendar(agg: DataFrame, month_col: str = "month") -> DataFrame:
    """K8, ``min..max observed`` mode: months between the first and last
    month present in ``agg`` (an aggregate, so this reads few rows)."""
    bounds = agg.agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
    return bounds.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month_col)
    )

"""Property tests for the period operators against a plain Python model."""

import calendar
import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlight.functions import periods as K


def model_add_months(d, n):
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


@given(st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2100, 12, 31)),
       st.integers(min_value=-40, max_value=40))
def test_add_months_matches_model(d, n):
    assert K.add_months(d, n) == model_add_months(d, n)


def test_add_months_clamps():
    assert K.add_months(dt.date(2024, 3, 31), -1) == dt.date(2024, 2, 29)
    assert K.add_months(dt.date(2024, 2, 29), 1) == dt.date(2024, 3, 29)


def test_parse_dates_half_open_and_order():
    w = K.parse_dates("2001-06-05", "2001-06-20")
    assert w.end_exclusive == dt.date(2001, 6, 21)
    with pytest.raises(ValueError):
        K.parse_dates("2001-06-20", "2001-06-05")


@given(st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31)),
       st.integers(min_value=1, max_value=28))
def test_lookback_start(d, months):
    s = K.lookback_start(d, d, months)
    assert (d.year * 12 + d.month) - (s.year * 12 + s.month) == months - 1
    assert s.day == min(d.day, calendar.monthrange(s.year, s.month)[1])


def test_lookback_empty_keeps_start():
    assert K.lookback_start("2001-01-15", "2001-06-20", None) == dt.date(2001, 1, 15)
    assert K.lookback_start("2001-01-15", "2001-06-20", 0) == dt.date(2001, 1, 15)


def test_month_anchors_13():
    lo, hi = K.month_anchors("2001-06-20", 13)
    assert lo == dt.date(2000, 6, 1) and hi == dt.date(2001, 7, 1)


def test_same_calendar_month():
    assert K.same_calendar_month("2001-06-05", "2001-06-20")
    assert not K.same_calendar_month("2001-05-20", "2001-06-10")


def test_default_windows():
    w = K.default_windows("2024-03-15")
    assert w["first_day_of_current_month"] == dt.date(2024, 3, 1)
    assert w["first_day_of_previous_month"] == dt.date(2024, 2, 1)
    assert w["first_day_of_previous_year"] == dt.date(2023, 1, 1)
    assert w["etl_window_start"] == dt.date(2023, 3, 16)


def model_wrap(day, s, e):
    return s <= day <= e if s <= e else (day >= s or day <= e)


def model_clamp(d, s, e):
    eom = calendar.monthrange(d.year, d.month)[1]
    return min(s, eom) <= d.day <= min(e, eom)


def test_day_windows_all_pairs_all_month_lengths(spark):
    """Every start/end day pair x month lengths 28-31, against the model."""
    from pyspark.sql import functions as F
    days = [dt.date(2023, 2, d) for d in range(1, 29)] + [dt.date(2024, 2, d) for d in range(1, 30)] \
        + [dt.date(2023, 4, d) for d in range(1, 31)] + [dt.date(2023, 1, d) for d in range(1, 32)]
    pairs = [(s, e) for s in range(1, 32) for e in range(1, 32)]
    df = spark.createDataFrame([(d,) for d in days], "d date").crossJoin(
        spark.createDataFrame(pairs, "s int, e int"))
    rows = df.select("d", "s", "e",
                     F.expr("CASE WHEN s <= e THEN day(d) BETWEEN s AND e ELSE day(d) >= s OR day(d) <= e END").alias("w"),
                     (F.dayofmonth("d") >= F.least("s", F.dayofmonth(F.last_day("d"))))
                     .__and__(F.dayofmonth("d") <= F.least("e", F.dayofmonth(F.last_day("d")))).alias("c")
                     ).collect()
    for r in rows:
        assert r.w == model_wrap(r.d.day, r.s, r.e)
        assert r.c == model_clamp(r.d, r.s, r.e)
    # The library builders on literals agree with the model too.
    sample = spark.createDataFrame([(d,) for d in days], "d date")
    for s, e in [(31, 31), (20, 10), (5, 20), (29, 30), (1, 31), (30, 28)]:
        got = sample.select("d", K.day_window_wrap("d", s, e).alias("w"),
                            K.day_window_clamp("d", s, e).alias("c")).collect()
        for r in got:
            assert r.w == model_wrap(r.d.day, s, e)
            assert r.c == model_clamp(r.d, s, e)


def test_clean_date(spark):
    df = spark.createDataFrame([("garbage",), ("1752-12-31",), ("1753-01-01",),
                                ("2024-02-29 10:00:00.123456",), (None,)], "s string")
    got = [r[0] for r in df.select(K.clean_date("s")).collect()]
    assert got[0] is None and got[1] is None and got[4] is None
    assert got[2] == dt.datetime(1753, 1, 1)
    assert got[3] == dt.datetime(2024, 2, 29, 10, 0, 0, 123456)

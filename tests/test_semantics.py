"""One test per remaining non-standard semantics row."""

import datetime as dt
import decimal
import os
import random

import pytest

from pyspark.sql import functions as F

from ledgerlight.functions import periods as K
from ledgerlight.operators import paging
from ledgerlight.plans import reports as R

D = dt.datetime


def _quotes(spark, rows):
    return spark.createDataFrame(rows, "QuoteNumber string, CreatedDate timestamp_ntz, PolicyNumber string, "
                                       "PolicyCreatedDate timestamp_ntz, CountryCode string, Brand string, "
                                       "PetType string")


def test_n12_null_ordering_in_pages(spark):
    df = spark.createDataFrame([("b", None), ("a", 1), ("c", 2)], "k string, v int")
    got = [r.k for r in paging.page(df, paging.asc("v", "k"), 0, 10).collect()]
    assert got == ["b", "a", "c"]  # NULL lowest: first ascending
    got = [r.k for r in paging.page(df, [paging.desc("v"), *paging.asc("k")], 0, 10).collect()]
    assert got == ["c", "a", "b"]  # ... and last descending


def test_n13_trailing_blanks_are_significant(spark):
    df = spark.createDataFrame([("a ",), ("a",)], "k string")
    assert df.where(F.col("k") == "a").count() == 1


def test_n21_two_day_window_rules_differ(spark):
    df = spark.createDataFrame([(dt.date(2023, 2, 28),), (dt.date(2023, 3, 30),)], "d date")
    wrap = [r[0] for r in df.select(K.day_window_wrap("d", 30, 31)).collect()]
    clamp = [r[0] for r in df.select(K.day_window_clamp("d", 30, 31)).collect()]
    assert wrap == [False, True]   # no clamping: February has no day 30
    assert clamp == [True, True]   # clamped to the month end: Feb 28 counts


def test_n22_conversion_v2_can_exceed_100(spark):
    quotes = _quotes(spark, [("Q1", D(2024, 1, 10), None, None, "UK", "B", "Cat")])
    sales = spark.createDataFrame([(f"P{i}", D(2024, 3, 5), "UK", "B", "Cat") for i in range(3)],
                                  "PolicyNumber string, CreatedDate timestamp_ntz, CountryCode string, "
                                  "Brand string, PetType string")
    row = R.conversion_v2(spark, quotes, sales, "2024-01-01", "2024-03-31").collect()[0]
    assert row.total_quotes == 1 and row.converted == 3
    assert row.conversion_percent == 300.0 and row.not_converted == 0
    assert row.not_converted_percent == -200.0


def test_n24_total_stays_right_past_the_last_page(spark):
    quotes = _quotes(spark, [(f"Q{i}", D(2024, 1, 10), None, None, "UK", "B", "Cat") for i in range(5)])
    page = R.quote_listing(quotes.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in
                                               ("QuoteStartDate", "QuoteExpiryDate", "PetBirthDate")})
                           .withColumns({c: F.lit("x") for c in ("CountryName", "QuoteReceivedMethod",
                                                                  "FullName", "Email", "ContactNo",
                                                                  "PetName", "BreedName", "Address",
                                                                  "PostCode")}),
                           "2024-01-01", "2024-01-31", dt.date(2024, 2, 1), skip=100, limit=10)
    assert page.count() == 0
    total = paging.total(quotes, "QuoteNumber").collect()[0][0]
    assert total == 5  # the total is its own aggregate, never carried on page rows


def test_n25_same_month_gate_depends_on_arguments_only(spark):
    assert K.same_calendar_month("2024-03-01", "2024-03-31")
    assert not K.same_calendar_month("2024-02-29", "2024-03-01")
    # Receive-method default: start six months back -> gate off, whole months count.
    assert not K.same_calendar_month(K.default_windows("2024-03-15")["six_months_back"], "2024-03-15")


def test_n9_not_in_drops_null_names_unless_asked(spark):
    from ledgerlight.functions import filters as D
    df = spark.createDataFrame([(40, None), (40, "ASIA"), (40, "OK"), (7, None)], "p int, n string")
    prod = [tuple(r) for r in df.where(D.product_exclusion("p", 40, "n", ["ASIA"])).collect()]
    keep = [tuple(r) for r in df.where(D.product_exclusion("p", 40, "n", ["ASIA"], keep_null_name=True))
            .collect()]
    assert sorted(prod, key=repr) == sorted([(40, "OK"), (7, None)], key=repr)
    assert sorted(keep, key=repr) == sorted([(40, None), (40, "OK"), (7, None)], key=repr)


PAGED = ("v double, k string, t timestamp_ntz, s timestamp, d date, b bigint, i int, m decimal(10,2), z boolean")


def _paged_rows(n, seed):
    """Few values a column, nulls in each, and values that nearly agree."""
    rng = random.Random(seed)

    def one(values):
        return None if rng.random() < 0.15 else rng.choice(values)

    t0 = dt.datetime(2001, 5, 1, 23, 59, 59, 999_998)
    return [(one([0.1, 0.1 + 1e-16, -2.5, float("nan"), 1e300]), one(["", "abcdefg", "abcdefgh", "abcdefghijklmnop", "ab", "ü"]),
             one([t0, t0 + dt.timedelta(microseconds=1), t0 + dt.timedelta(microseconds=5), t0 - dt.timedelta(days=400)]),
             one([dt.datetime(1969, 1, 2), dt.datetime(2030, 1, 1)]), one([dt.date(1950, 2, 3), dt.date(2020, 2, 3)]),
             one([-(2**63), 2**63 - 1, 0, 5]), one([-(2**31), 7]), one([decimal.Decimal("1.10"), decimal.Decimal("-3.25")]),
             one([True, False])) for _ in range(n)]


@pytest.mark.parametrize("lead", PAGED.replace(",2)", ";2)").split(", "))
def test_pages_by_rank_equal_slices_of_the_sort(spark, lead):
    """Whatever the first key's type and direction: the pages are the slices of
    one sort (equal rows are interchangeable)."""
    df = spark.createDataFrame(_paged_rows(400, 5), PAGED).repartition(3).persist()
    name = lead.split(" ")[0]
    for down in (False, True):
        order = [paging.SortKey(name, down), paging.SortKey("k", not down), *paging.asc("t", "b", "v"), paging.desc("m"),
                 *paging.asc("d", "i", "z", "s")]
        want = [repr(tuple(r)) for r in df.orderBy(*paging.sort_columns(order)).collect()]
        for skip, limit in ((0, 10), (37, 40), (250, 60), (395, 50), (400, 5), (1000, 5)):
            got = [repr(tuple(r)) for r in paging.page(df, order, skip, limit, top_rows=6).collect()]
            assert got == want[skip:skip + limit], (name, down, skip)
    df.unpersist()


def test_copies_of_one_row_are_paged_whole(spark):
    df = spark.createDataFrame([(1, "a")] * 300 + [(2, "b")] * 5 + [(None, "n")] * 40, "v int, k string")
    order = paging.asc("v", "k")
    want = [tuple(r) for r in df.orderBy(*paging.sort_columns(order)).collect()]
    for skip, limit in ((20, 10), (100, 30), (330, 15), (300, 45)):
        assert [tuple(r) for r in paging.page(df, order, skip, limit, top_rows=3).collect()] == want[skip:skip + limit]


def test_a_deep_page_sorts_and_writes_no_table(spark, tmp_path):
    """The page of a deep slice is a top-k behind a filter that reaches the
    scan, and refining costs counts alone."""
    from ledgerlight.session import shared_dir
    path = str(tmp_path / "t")
    days = F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 2000 as int))")
    spark.range(0, 40_000).select("id", days.alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    order = [paging.desc("t"), *paging.asc("id")]
    found = paging.boundary(df, order, 31_000, 50, top_rows=100)
    assert found.rest <= 100 and found.passes < 8
    out = paging.page(df, order, 31_000, 50, top_rows=100)
    want = [r.id for r in df.orderBy(F.col("t").desc(), "id").collect()][31_000:31_050]
    assert [r.id for r in out.collect()] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_pages_go_on_behind_the_last_row(spark):
    df = spark.createDataFrame(_paged_rows(300, 6), PAGED).distinct().persist()
    order = [paging.desc("k"), *paging.asc("t", "b"), paging.desc("i"), *paging.asc("m", "d", "z", "s", "v")]
    df = df.where("v is null or not isnan(v)")
    want = [tuple(r) for r in df.orderBy(*paging.sort_columns(order)).collect()]
    got, rows = [], paging.page(df, order, 0, 70).collect()
    while rows:
        got += [tuple(r) for r in rows]
        rows = paging.page_after(df, order, rows[-1].asDict(), 70).collect()
    assert got == want

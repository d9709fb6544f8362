"""Day summaries of the warehouse tables, kept by the loads (M9, M11, M15-M17,
M21, M22).

A summary has one row per month, country, brand, pet type and method (or
customer status and free policy), and for each measure an array of 31 running
totals: how much the month has counted up to each day.  Any stretch of days of a
month is a difference of two of its entries, so both day-window rules, partial
months at the ends of a window and whole months all read one short row per
month and group, instead of the fact.

Measures are counts, so they merge.  Quotes that are still open, whose state
depends on the report's own date, are counted per day and expiry day in a second
table.  A summary row carries the version of the fact's month it was made from;
``refresh`` rebuilds the months whose version is another by now, and only those,
through the same windowed replace as the fact (an emptied month goes).  It can be
run again at any time, also after a run that stopped between load and refresh.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import columns as C
from ledgerlight.functions import filters as D
from ledgerlight.functions import periods as K
from ledgerlight.operators import load, reshape
from ledgerlight.operators.claims import Claim
from ledgerlight.plans import reports as R
from ledgerlight.session import shared_dir

MONTH, VERSION = "month_start", "source_version"


@dataclass(frozen=True)
class Spec:
    """A summary: the fact's date and group columns, and its measures."""
    date_col: str
    keys: tuple[str, ...]
    measures: dict[str, Callable[[], Column]]


SPECS = {
    "quote": Spec("CreatedDate", ("CountryCode", "Brand", "PetType", "QuoteReceivedMethod"), {
        "rows": lambda: F.count(F.lit(1)), "counted": lambda: F.count("QuoteNumber"),
        "incomplete": lambda: F.count_if(C.incomplete())}),
    "sales": Spec("CreatedDate", ("CountryCode", "Brand", "PetType", "SaleMethod"), {
        "rows": lambda: F.count(F.lit(1)), "counted": lambda: F.count("PolicyNumber")}),
    "crm": Spec("QuoteStartDate", ("CountryCode", "Brand", "PetType", "CustomerStatus", "FreePolicy"), {
        "rows": lambda: F.count(F.lit(1))}),
}
# Group columns of the open quotes.
OPEN_KEYS = ("CountryCode", "Brand", "PetType")


# ---- building and keeping ----------------------------------------------------

def build(fact: DataFrame, spec: Spec) -> DataFrame:
    """The summary of ``fact`` (rows without a date have no month and are left out)."""
    days = (fact.where(F.col(spec.date_col).isNotNull())
            .groupBy(K.month_start(spec.date_col).alias(MONTH), *spec.keys, F.dayofmonth(spec.date_col).alias("_day"))
            .agg(*[count().alias(m) for m, count in spec.measures.items()]))
    # At most 31 entries a group.
    months = days.groupBy(MONTH, *spec.keys).agg(F.collect_list(F.struct("_day", *spec.measures)).alias("_days"))

    def to_day(m: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.aggregate(
            F.filter("_days", lambda e: e["_day"] <= d), F.lit(0).cast("long"), lambda total, e: total + e[m]))

    return months.select(MONTH, *spec.keys, *[to_day(m).alias(m) for m in spec.measures])


def build_open(quote: DataFrame) -> DataFrame:
    """Quotes without a policy by day and expiry day."""
    base = quote.where(F.col("CreatedDate").isNotNull() & F.col("QuoteExpiryDate").isNotNull() & C.not_converted("PolicyNumber"))
    return (base.groupBy(F.to_date("CreatedDate").alias("day"), *OPEN_KEYS, F.to_date("QuoteExpiryDate").alias("expiry_day"))
            .agg(F.count(F.lit(1)).alias("open_quotes")))


def _versions(spark: SparkSession, target: str) -> dict[str, str]:
    found = load.month_versions(spark, target, load.all_months(spark, target))
    return {m: hashlib.sha256(v.encode()).hexdigest()[:16] for m, v in found.items()}


def stale_months(spark: SparkSession, fact_target: str, summary_target: str) -> list[str]:
    """Months whose summary was not made from the fact's month as it is."""
    want, made = _versions(spark, fact_target), {}
    summary = load.read_target(spark, summary_target)
    if summary is not None:
        made = {r[0]: r[1] for r in summary.groupBy(load.MONTH_COL).agg(F.min(VERSION)).collect()}
    return sorted(m for m in want.keys() | made.keys() if want.get(m) != made.get(m))


def _stretches(months: list[str]) -> list[tuple[dt.date, dt.date]]:
    """First and last day of each stretch of consecutive months."""
    out: list[tuple[dt.date, dt.date]] = []
    for m in months:
        first = dt.date.fromisoformat(f"{m}-01")
        last = K.add_months(first, 1) - dt.timedelta(days=1)
        if out and out[-1][1] + dt.timedelta(days=1) == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def refresh(spark: SparkSession, kind: str, fact_target: str, summary_target: str, work_dir: str | None = None) -> list[str]:
    """Bring the summary in line with the fact; the months that were rebuilt.
    One refresh of a summary runs at a time: each reads the fact only when its
    turn has come, so a later one never puts back what an earlier one saw."""
    work = (work_dir or shared_dir(spark)).rstrip("/")
    folder = f"{work}/_refresh/{hashlib.sha256(summary_target.encode()).hexdigest()[:16]}"
    spec = SPECS[kind]
    with Claim(spark, folder) as claim:
        months = stale_months(spark, fact_target, summary_target)
        versions = _versions(spark, fact_target)
        for first, last in _stretches(months):
            claim.check()
            rows = load.read_target(spark, fact_target)
            if rows is None:  # every month has been emptied
                rows = load.read_target(spark, summary_target).limit(0)
            else:
                rows = build(load.read_window(spark, fact_target, first, last, spec.date_col), spec)
                known = F.create_map(*[F.lit(x) for m in versions for x in (m, versions[m])]) if versions else None
                version = known[F.date_format(MONTH, "yyyy-MM")] if known is not None else F.lit(None).cast("string")
                rows = rows.withColumn(VERSION, version)
            load.windowed_replace(spark, rows, summary_target, first, last, date_col=MONTH, work_dir=work)
            if kind == "quote":
                there = load.read_target(spark, fact_target)
                opened = (build_open(load.read_window(spark, fact_target, first, last, spec.date_col)) if there is not None
                          else load.read_target(spark, open_target(summary_target)).limit(0))
                load.windowed_replace(spark, opened, open_target(summary_target), first, last, date_col="day", work_dir=work)
    return months


def open_target(summary_target: str) -> str:
    """Where the open quotes beside a quote summary are."""
    return f"{summary_target}_open"


# ---- reading -----------------------------------------------------------------

def upto(measure: str, day: Column) -> Column:
    """Running total at the end of a day (0 for day 0)."""
    return F.when(day < 1, F.lit(0).cast("long")).otherwise(F.element_at(F.col(measure), F.greatest(day, F.lit(1))))


def between_days(measure: str, first: Column, last: Column) -> Column:
    """Total of days ``first .. last`` of each month, 0 if ``first > last``."""
    return F.when(first <= last, upto(measure, last) - upto(measure, first - 1)).otherwise(F.lit(0).cast("long"))


def in_window(measure: str, start, end) -> Column:
    """Total of the days of each month that lie in ``[start, end]``."""
    s, e = K.to_date(start), K.to_date(end)
    month = F.col(MONTH)
    first = F.when(month == F.lit(s.replace(day=1)), F.lit(s.day)).otherwise(F.lit(1))
    last = F.when(month == F.lit(e.replace(day=1)), F.lit(e.day)).otherwise(F.lit(31))
    inside = month.between(F.lit(s.replace(day=1)), F.lit(e.replace(day=1)))
    return F.when(inside, between_days(measure, first, last)).otherwise(F.lit(0).cast("long"))


def wrapped(measure: str, start_day: int, end_day: int) -> Column:
    """K-wrap on running totals."""
    if start_day <= end_day:
        return between_days(measure, F.lit(start_day), F.lit(end_day))
    return upto(measure, F.lit(31)) - upto(measure, F.lit(start_day - 1)) + upto(measure, F.lit(end_day))


def clamped(measure: str, start, end, start_day: int, end_day: int) -> Column:
    """K-clamp on running totals, within ``[start, end]``."""
    s, e = K.to_date(start), K.to_date(end)
    month, eom = F.col(MONTH), F.dayofmonth(F.last_day(MONTH))
    first = F.least(F.lit(start_day), eom)
    last = F.least(F.lit(end_day), eom)
    first = F.when(month == F.lit(s.replace(day=1)), F.greatest(first, F.lit(s.day))).otherwise(first)
    last = F.when(month == F.lit(e.replace(day=1)), F.least(last, F.lit(e.day))).otherwise(last)
    inside = month.between(F.lit(s.replace(day=1)), F.lit(e.replace(day=1)))
    return F.when(inside, between_days(measure, first, last)).otherwise(F.lit(0).cast("long"))


def _months(summary: DataFrame, start, end, *preds: Column) -> DataFrame:
    """The months of ``[start, end]`` (partitions, where there are any)."""
    s, e = K.to_date(start), K.to_date(end)
    rows = summary.where(D.conjunction([F.col(MONTH).between(F.lit(s.replace(day=1)), F.lit(e)), *preds]))
    return rows.where(F.col(load.MONTH_COL).between(f"{s:%Y-%m}", f"{e:%Y-%m}")) if load.MONTH_COL in summary.columns else rows


def quote_kpis(summary: DataFrame, opened: DataFrame, start, end, as_of: dt.date,
               countries="all", brands="all", pets="all") -> DataFrame:
    """M9 as ``reports.quote_kpis``, from the quote summary and its open quotes."""
    cur, prev = K.parse_dates(start, end), K.previous_period(start, end)
    flt = D.report_filters(countries, brands, pets)
    counts = _months(summary, prev.start, cur.end, flt).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in {
        "currentPeriodTotalQuotes": in_window("rows", cur.start, cur.end),
        "lastPeriodTotalQuotes": in_window("rows", prev.start, prev.end),
        "incompleteQuoteDetails": in_window("incomplete", cur.start, cur.end)}.items()])
    live = F.col("expiry_day") >= F.lit(as_of)
    states = opened.where(D.conjunction([K.in_window("day", cur.start, cur.end), flt]))
    if load.MONTH_COL in opened.columns:
        states = states.where(F.col(load.MONTH_COL).between(f"{cur.start:%Y-%m}", f"{cur.end:%Y-%m}"))
    states = states.agg(F.coalesce(F.sum(F.when(live, F.col("open_quotes"))), F.lit(0)).alias("liveQuotes"),
                        F.coalesce(F.sum(F.when(~live, F.col("open_quotes"))), F.lit(0)).alias("lapsedQuotes"))
    total, bad = F.col("currentPeriodTotalQuotes"), F.col("incompleteQuoteDetails")
    return R.paging.attach_scalars(counts, states).select(
        total, "lastPeriodTotalQuotes", "liveQuotes", "lapsedQuotes", bad,
        R._rounded_percent_text(total - bad, total).alias("quotesCompleteness"))


def monthly_series(summary: DataFrame, start, end, countries="all", brands="all", pets="all",
                   months: int = config.SERIES_MONTHS) -> DataFrame:
    """M9/M16 series as ``reports.monthly_series``."""
    s, e = K.to_date(start), K.to_date(end)
    oldest, upper = K.month_anchors(e, months)
    value = wrapped("counted", s.day, e.day) if K.same_calendar_month(s, e) else upto("counted", F.lit(31))
    rows = _months(summary, oldest, upper - dt.timedelta(days=1), D.report_filters(countries, brands, pets))
    agg = rows.groupBy(F.col(MONTH).alias("month")).agg(F.sum(value).alias("value"))
    cal = K.month_calendar(summary.sparkSession, oldest, K.add_months(upper, -1))
    out = reshape.align_to_calendar(cal, agg, "month", ["value"])
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"), "value")


def count_by_pet_bucket(summary: DataFrame, start, end, countries="all", brands="all", pets="all") -> DataFrame:
    """M11/M17 as ``reports.count_by_pet_bucket``."""
    rows = _months(summary, start, end, D.report_filters(countries, brands, pets))
    return (rows.groupBy(C.report_pet_bucket("PetType").alias("name"))
            .agg(F.sum(in_window("counted", start, end)).alias("value"), F.sum(in_window("rows", start, end)).alias("_rows"))
            .where("_rows > 0").drop("_rows"))


def method_trend(summary: DataFrame, method_col: str, start, end, months: int | None = config.METHOD_TREND_MONTHS,
                 countries="all", brands="all", pets="all", clamp_always: bool = False) -> DataFrame:
    """M15/M21 chart as ``reports.method_trend``."""
    s, e = K.to_date(start), K.to_date(end)
    used = K.lookback_start(s, e, months)
    clamp = clamp_always or K.same_calendar_month(s, e)

    def of(measure: str) -> Column:
        return clamped(measure, used, e, s.day, e.day) if clamp else in_window(measure, used, e)

    agg = (_months(summary, used, e, D.report_filters(countries, brands, pets))
           .groupBy(F.col(method_col).alias("method"), F.col(MONTH).alias("month"))
           .agg(F.sum(of("counted")).alias("value"), F.sum(of("rows")).alias("_rows")).where("_rows > 0"))
    norm = agg.withColumn("method", C.normalised_method("method"))
    wide = reshape.pivot_sum(norm, "month", "method", "value", config.TREND_METHODS)
    out = reshape.align_to_calendar(K.month_calendar_if_rows(agg, used, e), wide, "month", config.TREND_METHODS)
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"),
                      *config.TREND_METHODS)


def policy_month_trend(summary: DataFrame, start, end, months: int | None = config.POLICY_TREND_MONTHS,
                       regions="all", policy_status="all", policy_type="all", brands="all", pets="all") -> DataFrame:
    """M22 as ``reports.policy_month_trend`` on the date that the CRM table is
    loaded by."""
    s, e = K.to_date(start), K.to_date(end)
    used = K.lookback_start(s, e, months)
    rows = _months(summary, used, e, D.conjunction([
        D.membership("CountryCode", D.normalize_regions(regions)), D.membership("Brand", D.normalize_input(brands)),
        D.pet_filter("PetType", D.normalize_input(pets)), D.membership("CustomerStatus", D.status_list(policy_status) or []),
        D.membership("FreePolicy", D.free_policy_list(policy_type) or [])]))
    agg = (rows.groupBy(F.col(MONTH).alias("month")).agg(F.sum(clamped("rows", used, e, s.day, e.day)).alias("policyCount"))
           .where("policyCount > 0"))
    out = reshape.align_to_calendar(K.observed_calendar(agg, "month"), agg, "month", ["policyCount"])
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"), "policyCount")

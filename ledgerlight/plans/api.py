"""The reporting API: one function per reference endpoint.

Same argument names and defaults as the endpoints, with the date defaults
computed per call from ``as_of`` (K9; the reference computes them from the
wall clock, the ETL default once at import).  Every function returns lazy
DataFrames -- a report with several parts returns a dict of them -- and the
``download=True`` forms write a CSV export (B10, B11) to ``out_dir`` (default:
the shared work folder) and return its path.  Arguments the reference accepts
and never uses (``reportType``, ``quoteStatus``) are accepted and ignored the
same way.  Lists come back in the reference's order (H4): pet buckets by
name descending, charts by month, breakdown lists by value descending.

``Warehouse`` tables are passed as DataFrames so callers choose how they are
read (a pruned ``plans.warehouse.Warehouse.read`` in production, the fixture
adapters in tests).
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import periods as K
from ledgerlight.operators import breakdown, reshape
from ledgerlight.plans import etl
from ledgerlight.plans import reports as R
from ledgerlight.session import shared_dir
from ledgerlight.sources.snapshots import Snapshot, as_many_partitions
from ledgerlight.streaming import csv_export


@dataclass
class Tables:
    """Warehouse tables the reports read."""

    spark: SparkSession
    quote: DataFrame | None = None
    sales: DataFrame | None = None
    free_policy: DataFrame | None = None
    crm: DataFrame | None = None

    @classmethod
    def from_warehouse(cls, spark: SparkSession, root: str) -> "Tables":
        """The loader-written tables under ``root`` (missing ones stay None).
        Reports add the ``created_month`` range to their windows, so every
        endpoint reads only the months it needs."""
        from ledgerlight.operators import load
        from ledgerlight.plans.warehouse import Warehouse
        wh = Warehouse(spark, root)

        def table(name: str) -> DataFrame | None:
            return load.read_target(spark, wh.path(name))

        return cls(spark, quote=table("Quote"), sales=table("Sales"),
                   free_policy=table("FreePolicySales"), crm=table("CRM"))


def _today(as_of) -> dt.date:
    return K.to_date(as_of) if as_of is not None else dt.date.today()


def _window(start_date, end_date, as_of, months_back: int = 0) -> tuple[dt.date, dt.date]:
    """Endpoint defaults: start = first of the month (minus ``months_back``
    months), end = today."""
    today = _today(as_of)
    start = K.to_date(start_date) if start_date else K.add_months(today.replace(day=1), -months_back)
    end = K.to_date(end_date) if end_date else today
    return start, end


def _export(t: Tables, rows: DataFrame, order, filename: str, start, end, out_dir,
            day_window=None) -> str:
    name = csv_export.export_filename(filename, start, end, day_window)
    base = (out_dir or f"{shared_dir(t.spark)}/exports/{uuid.uuid4().hex}").rstrip("/")
    return csv_export.write_csv(rows, f"{base}/{name}", order=order)


# ---------------------------------------------------------------------------
# Quote endpoints
# ---------------------------------------------------------------------------

def quote_summary(t: Tables, start_date=None, end_date=None, country_codes="all", brands="all",
                  pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """M9: KPI row and the 13-month graph."""
    s, e = _window(start_date, end_date, as_of)
    return {"summary": R.quote_kpis(t.quote, s, e, _today(as_of), country_codes, brands, pet_types),
            "graphData": R.monthly_series(t.spark, t.quote, "CreatedDate", "QuoteNumber", s, e,
                                          country_codes, brands, pet_types).orderBy("period")}


def quote_data(t: Tables, start_date=None, end_date=None, country_codes="all", skip=0, limit=100,
               download=False, filename="quote.csv", brands="all", pet_types="all",
               reportType=None, as_of=None, out_dir=None):  # noqa: N803 (reference name)
    """JSON page with total, or the CSV export."""
    s, e = _window(start_date, end_date, as_of)
    if download:
        rows, order = R.quote_export_rows(t.quote, s, e, _today(as_of), country_codes, brands,
                                          pet_types, shape="quote_csv")
        return _export(t, rows, order, filename, s, e, out_dir)
    return R.quote_listing(t.quote, s, e, _today(as_of), country_codes, brands, pet_types, skip, limit)


def quote_summary_by_pet_type(t: Tables, start_date=None, end_date=None, country_codes="all",
                              brands="all", pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """Counts per pet bucket and their total."""
    s, e = _window(start_date, end_date, as_of)
    by = R.count_by_pet_bucket(t.quote, "QuoteNumber", s, e, country_codes, brands, pet_types)
    return {"summary": by.orderBy(F.col("name").desc()), "total": R.bucket_total(by)}


def quote_data_by_pet_type(t: Tables, start_date=None, end_date=None, country_codes="all",
                           quoteStatus="All", skip=0, limit=100, download=False,  # noqa: N803
                           filename="quote_by_pet_type.csv", brands="all", pet_types="all",
                           as_of=None, out_dir=None):
    """Listing without the completeness column."""
    s, e = _window(start_date, end_date, as_of)
    if download:
        rows, order = R.quote_export_rows(t.quote, s, e, _today(as_of), country_codes, brands,
                                          pet_types, shape="quote_csv")
        return _export(t, rows, order, filename, s, e, out_dir)
    return R.quote_listing(t.quote, s, e, _today(as_of), country_codes, brands, pet_types, skip, limit,
                           shape="by_pet_type")


def quote_conversion_summary(t: Tables, start_date=None, end_date=None, country_codes="all",
                             brands="all", pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """The production (v2) figures and the same-period form."""
    s, e = _window(start_date, end_date, as_of)
    return {"conversion": R.conversion_v2(t.spark, t.quote, t.sales, s, e, country_codes, brands,
                                          pet_types),
            "same_period": R.conversion_same_period(t.quote, s, e, country_codes, brands, pet_types)}


def quote_conversion_data(t: Tables, start_date=None, end_date=None, country_codes="all", skip=0,
                          limit=100, download=False, filename="quote_conversion.csv", brands="all",
                          pet_types="all", as_of=None, out_dir=None):
    """Listing with policy dates, or its CSV export."""
    s, e = _window(start_date, end_date, as_of)
    if download:
        rows, order = R.quote_export_rows(t.quote, s, e, _today(as_of), country_codes, brands,
                                          pet_types, shape="conversion_csv")
        return _export(t, rows, order, filename, s, e, out_dir)
    return R.quote_listing(t.quote, s, e, _today(as_of), country_codes, brands, pet_types, skip, limit,
                           shape="conversion")


def quote_rmth_same_period_summary(t: Tables, start_date=None, end_date=None, country_codes="all",
                                   historical_months=config.METHOD_TREND_MONTHS, brands="all",
                                   pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """M15 trend: chart and totals by receive method."""
    s, e = _window(start_date, end_date, as_of, months_back=6)
    return {"chart": R.method_trend(t.spark, t.quote, "QuoteReceivedMethod", "QuoteNumber", s, e,
                                    historical_months, country_codes, brands, pet_types).orderBy("period"),
            "totals": R.method_totals(t.quote, "QuoteReceivedMethod", "QuoteNumber", s, e,
                                      historical_months, country_codes, brands, pet_types)}


def quote_rmth_same_period_report(t: Tables, start_date=None, end_date=None, country_codes="all",
                                  skip=0, limit=100, download=False,
                                  filename="quote_receive_method.csv",
                                  historical_months=config.METHOD_TREND_MONTHS, brands="all",
                                  pet_types="all", as_of=None, out_dir=None):
    """M15 listing: look-back window, clamped day window in every month."""
    s, e = _window(start_date, end_date, as_of, months_back=6)
    if download:
        rows, order = R.quote_export_rows(t.quote, s, e, _today(as_of), country_codes, brands,
                                          pet_types, shape="conversion", months=historical_months,
                                          clamp_days=True)
        return _export(t, rows, order, filename, K.lookback_start(s, e, historical_months), e, out_dir)
    return R.quote_listing(t.quote, s, e, _today(as_of), country_codes, brands, pet_types, skip, limit,
                           shape="conversion", months=historical_months, clamp_days=True)


# ---------------------------------------------------------------------------
# Sales endpoints
# ---------------------------------------------------------------------------

def sales_summary(t: Tables, start_date=None, end_date=None, country_codes="all", brands="all",
                  pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """The 13-month sales graph."""
    s, e = _window(start_date, end_date, as_of)
    return {"graphData": R.monthly_series(t.spark, t.sales, "CreatedDate", "PolicyNumber", s, e,
                                          country_codes, brands, pet_types).orderBy("period")}


def sales_data(t: Tables, start_date=None, end_date=None, country_codes="all", skip=0, limit=100,
               download=False, filename="sales.csv", brands="all", pet_types="all",
               reportType=None, as_of=None, out_dir=None):  # noqa: N803
    """Sales page with total, or the CSV export."""
    s, e = _window(start_date, end_date, as_of)
    if download:
        rows, order = R.sales_export_rows(t.sales, s, e, country_codes, brands, pet_types)
        return _export(t, rows, order, filename, s, e, out_dir)
    return R.sales_listing(t.sales, s, e, country_codes, brands, pet_types, skip, limit)


def sales_by_pet_type(t: Tables, start_date=None, end_date=None, country_codes="all", brands="all",
                      pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """M17."""
    s, e = _window(start_date, end_date, as_of)
    by = R.count_by_pet_bucket(t.sales, "PolicyNumber", s, e, country_codes, brands, pet_types)
    return {"summary": by.orderBy(F.col("name").desc()), "total": R.bucket_total(by)}


def free_policy_sales(t: Tables, start_date=None, end_date=None, country_codes="all", brands="all",
                      pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """Status / pet type / channel breakdowns with shares (one pass),
    split into the three lists (L4) plus the grand total of the status list
    (F12)."""
    s, e = _window(start_date, end_date, as_of)
    tagged = R.free_policy_breakdown(t.free_policy, s, e, country_codes, brands, pet_types)
    by_value = [F.col("value").desc(), F.col("name").asc_nulls_first()]
    return {"by_status": reshape.split_level(tagged, "status").orderBy(*by_value),
            "by_pet_type": reshape.split_level(tagged, "pet_type").orderBy(*by_value),
            "by_channel": reshape.split_level(tagged, "channel").orderBy(*by_value),
            "total": breakdown.grand_total(tagged, "status")}


def free_policy_data(t: Tables, start_date=None, end_date=None, country_codes="all", skip=0,
                     limit=100, download=False, filename="free_policy.csv", brands="all",
                     pet_types="all", reportType=None, as_of=None, out_dir=None):  # noqa: N803
    """Free-policy page with total, or the CSV export."""
    s, e = _window(start_date, end_date, as_of)
    if download:
        rows, order = R.free_export_rows(t.free_policy, s, e, country_codes, brands, pet_types)
        return _export(t, rows, order, filename, s, e, out_dir)
    return R.free_listing(t.free_policy, s, e, country_codes, brands, pet_types, skip, limit)


def sales_rmth_same_period(t: Tables, start_date=None, end_date=None, country_codes="all",
                           historical_months=config.METHOD_TREND_MONTHS, brands="all",
                           pet_types="all", as_of=None) -> dict[str, DataFrame]:
    """Sale-method trend and totals."""
    s, e = _window(start_date, end_date, as_of, months_back=6)
    return {"chart": R.method_trend(t.spark, t.sales, "SaleMethod", "PolicyNumber", s, e,
                                    historical_months, country_codes, brands, pet_types).orderBy("period"),
            "totals": R.method_totals(t.sales, "SaleMethod", "PolicyNumber", s, e, historical_months,
                                      country_codes, brands, pet_types)}


# ---------------------------------------------------------------------------
# Policy endpoints
# ---------------------------------------------------------------------------

def policy_summary(t: Tables, start_date=None, end_date=None, regions="all", policy_status="all",
                   free_policy="all", historical_months=config.METHOD_TREND_MONTHS,
                   date_basis=config.DEFAULT_DATE_BASIS, brands="all", pet_types="all",
                   as_of=None) -> DataFrame:
    """Monthly policy counts on a date basis."""
    s, e = _window(start_date, end_date, as_of, months_back=12)
    return R.policy_month_trend(t.crm, s, e, historical_months, date_basis, regions, policy_status,
                                free_policy, brands, pet_types).orderBy("period")


def policy_summary_total(t: Tables, start_date=None, end_date=None, regions="all", policy_status="all",
                         free_policy="all", historical_months=config.METHOD_TREND_MONTHS,
                         date_basis=config.DEFAULT_DATE_BASIS, brands="all", pet_types="all",
                         as_of=None) -> DataFrame:
    """``total_policies`` of the same rows."""
    trend = policy_summary(t, start_date, end_date, regions, policy_status, free_policy, historical_months,
                           date_basis, brands, pet_types, as_of)
    return R.grand_total(trend, "policyCount", "total_policies")


def policy_data(t: Tables, start_date=None, end_date=None, regions="all", policy_status="all",
                free_policy="all", skip=0, limit=100, download=False, filename="Policy.csv",
                historical_months=config.METHOD_TREND_MONTHS, date_basis=config.DEFAULT_DATE_BASIS,
                order="DESC", brands="all", pet_types="all", as_of=None, extracted_at=None,
                out_dir=None):
    """CRM page with total, or the CSV export (file name carries the
    day window)."""
    s, e = _window(start_date, end_date, as_of, months_back=12)
    stamp = extracted_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if download:
        rows, ordering = R.policy_export_rows(t.crm, s, e, stamp, historical_months, date_basis,
                                              regions, policy_status, free_policy, brands, pet_types,
                                              order)
        return _export(t, rows, ordering, filename, K.lookback_start(s, e, historical_months), e,
                       out_dir, day_window=(s.day, e.day))
    return R.policy_listing(t.crm, s, e, stamp, historical_months, date_basis, regions, policy_status,
                            free_policy, brands, pet_types, order, skip, limit)


# ---------------------------------------------------------------------------
# ETL endpoints
# ---------------------------------------------------------------------------

def _etl_window(start_date, end_date, as_of) -> tuple[dt.date, dt.date]:
    today = _today(as_of)
    return (K.to_date(start_date) if start_date else today - dt.timedelta(days=365),
            K.to_date(end_date) if end_date else today)


def etl_quote(spark: SparkSession, sources: Mapping, target: str, start_date=None, end_date=None,
              as_of=None, *, domain: config.Domain):
    s, e = _etl_window(start_date, end_date, as_of)
    return etl.run_etl(spark, "quote", sources, s, e, _today(as_of), target, domain)


def etl_sales(spark: SparkSession, sources: Mapping, target: str, start_date=None, end_date=None,
              as_of=None, *, domain: config.Domain):
    s, e = _etl_window(start_date, end_date, as_of)
    return etl.run_etl(spark, "sales", sources, s, e, _today(as_of), target, domain)


def etl_free_policies(spark: SparkSession, sources: Mapping, target: str, start_date=None,
                      end_date=None, as_of=None, *, domain: config.Domain):
    s, e = _etl_window(start_date, end_date, as_of)
    return etl.run_etl(spark, "free_policies", sources, s, e, _today(as_of), target, domain)


def etl_crm(spark: SparkSession, sources: Mapping, target: str, start_date=None, end_date=None,
            as_of=None, *, domain: config.Domain):
    """The CRM loader (no endpoint runs it in the reference; the policy
    reports read its table)."""
    s, e = _etl_window(start_date, end_date, as_of)
    return etl.run_etl(spark, "crm", sources, s, e, _today(as_of), target, domain)


def etl_route(spark: SparkSession, sources: Mapping, targets: Mapping[str, str], start_date=None,
              end_date=None, as_of=None, *, domain: config.Domain, snapshots: bool = False):
    """Quote, sales and free policies in turn (as the reference does).  With
    ``snapshots`` each source table is read once and copied by join key for the
    three loads."""
    args = dict(start_date=start_date, end_date=end_date, as_of=as_of, domain=domain)

    def loads(sources):
        return {"quote": etl_quote(spark, sources, targets["quote"], **args),
                "sales": etl_sales(spark, sources, targets["sales"], **args),
                "free_policies": etl_free_policies(spark, sources, targets["free_policies"], **args)}

    if not snapshots:
        return loads(sources)
    taken = {code: Snapshot(spark, src) for code, src in sources.items()}
    try:
        with as_many_partitions(spark, int(spark.conf.get("spark.sql.shuffle.partitions"))):
            return loads(taken)
    finally:
        for snapshot in taken.values():
            snapshot.close()

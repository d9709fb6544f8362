"""Driver queries over day summaries that the loads keep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import periods as K
from ledgerlight.operators import load, paging
from ledgerlight.plans import reports as R
from ledgerlight.plans import summary
from ledgerlight.queries import report_queries as Q
from ledgerlight.registry import REGISTRY, register
from ledgerlight.session import shared_dir

SHRUNK = ("2001-06-10", "2001-06-30")
# The fact after a reload of SHRUNK that brings fewer rows.
AFTER = """{wh}_after AS MATERIALIZED (SELECT * FROM {wh} WHERE {date} IS NOT NULL AND NOT (
             CAST({date} AS DATE) BETWEEN DATE '2001-06-10' AND DATE '2001-06-30' AND day({date}) % 3 = 0))"""


def _kept(src, kind: str, view: str):
    """Paths of a fact and its summary: loaded whole and summarised, then one
    window reloaded with fewer rows and only its month summarised again."""
    spark, spec = src.spark, summary.SPECS[kind]
    root = f"{shared_dir(spark)}/ledgerlight-days-{uuid.uuid4().hex}"
    fact, days = f"{root}/fact", f"{root}/days"
    rows = src[view]
    load.windowed_replace(spark, rows, fact, *config.FULL_WINDOW, date_col=spec.date_col)
    summary.refresh(spark, kind, fact, days)
    fewer = rows.where(K.in_window(spec.date_col, *SHRUNK) & (F.dayofmonth(spec.date_col) % 3 != 0))
    load.windowed_replace(spark, fewer, fact, *SHRUNK, date_col=spec.date_col)
    summary.refresh(spark, kind, fact, days)
    return fact, days


def _after(wh: str, date: str, body: str) -> str:
    """An oracle over the fact as the second load leaves it."""
    body = body.strip().replace(wh, f"{wh}_after")
    cte = AFTER.format(wh=wh, date=date)
    return f"WITH {cte}, {body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {cte}\n{body}"


@register("summary_kpis", ("quote_wh",), ids="M9 F1 D16", oracle_fn=lambda: _after(
    "quote_wh", "CreatedDate", REGISTRY["kpi_summary"].oracle_body))
def summary_kpis(src):
    _, days = _kept(src, "quote", "quote_wh")
    read = src.spark.read.parquet
    return summary.quote_kpis(read(days), read(summary.open_target(days)), *Q.MW, Q.AS_OF, Q.COUNTRIES, "all", Q.PETS)


@register("summary_sales_series", ("sales_wh",), ids="M16 F5 K4 K6 K-wrap K8", oracle_fn=lambda: _after(
    "sales_wh", "CreatedDate", REGISTRY["sales_series_13m"].oracle_body))
def summary_sales_series(src):
    return summary.monthly_series(src.spark.read.parquet(_kept(src, "sales", "sales_wh")[1]), *Q.MW)


@register("summary_sales_by_bucket", ("sales_wh",), ids="M17 F4 C14 F12", oracle_fn=lambda: _after(
    "sales_wh", "CreatedDate", REGISTRY["sales_by_bucket"].oracle_body))
def summary_sales_by_bucket(src):
    days = src.spark.read.parquet(_kept(src, "sales", "sales_wh")[1])
    by = summary.count_by_pet_bucket(days, *Q.WW, countries=Q.COUNTRIES)
    return paging.attach_scalars(by, R.bucket_total(by))


@register("summary_method_trend", ("quote_wh",), ids="M15 F6 L1 L2 K5 K-clamp K8", oracle_fn=lambda: _after(
    "quote_wh", "CreatedDate", REGISTRY["method_trend_pivot"].oracle_body))
def summary_method_trend(src):
    return summary.method_trend(src.spark.read.parquet(_kept(src, "quote", "quote_wh")[1]), "QuoteReceivedMethod", *Q.MW)


@register("summary_policy_trend", ("crm_wh",), ids="M22 F7 K-clamp K8", oracle_fn=lambda: _after(
    "crm_wh", "QuoteStartDate", Q._policy_trend_oracle("QuoteStartDate", "2000-12-15", "2001-06-21", 15, 20, "")))
def summary_policy_trend(src):
    return summary.policy_month_trend(src.spark.read.parquet(_kept(src, "crm", "crm_wh")[1]), *Q.WW, months=7)

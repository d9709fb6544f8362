"""Day summaries give the reports' own results, and follow the loads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixture_paths import SF001
from ledgerlight import config
from ledgerlight.operators import load
from ledgerlight.plans import reports as R
from ledgerlight.plans import summary
from ledgerlight.sources.adapters import Sources

WINDOWS = [("2001-06-05", "2001-06-20"), ("2001-01-15", "2001-06-20"), ("2001-05-20", "2001-06-10"),
           ("2001-01-31", "2001-02-28"), ("2000-02-29", "2000-02-29"), ("2001-04-30", "2001-05-31")]


@pytest.fixture(scope="module")
def facts(spark):
    src = Sources(spark, SF001)
    out = {}
    for kind, view in (("quote", "quote_wh"), ("sales", "sales_wh"), ("crm", "crm_wh")):
        fact = src[view].persist()
        out[kind] = (fact, summary.build(fact, summary.SPECS[kind]).persist())
    return out


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("window", WINDOWS)
def test_reports_from_the_summary_equal_reports_from_the_fact(spark, facts, window):
    quote, days = facts["quote"]
    flt = {"countries": "africa, ASIA", "pets": "Cat,dog"}
    opened = summary.build_open(quote)
    assert rows_of(summary.quote_kpis(days, opened, *window, config.AS_OF, **flt)) == rows_of(R.quote_kpis(quote, *window, config.AS_OF, **flt))
    assert rows_of(summary.monthly_series(days, *window, **flt)) == rows_of(
        R.monthly_series(spark, quote, "CreatedDate", "QuoteNumber", *window, **flt))
    for clamp in (False, True):
        assert rows_of(summary.method_trend(days, "QuoteReceivedMethod", *window, clamp_always=clamp)) == rows_of(
            R.method_trend(spark, quote, "QuoteReceivedMethod", "QuoteNumber", *window, clamp_always=clamp))
    sales, sale_days = facts["sales"]
    assert rows_of(summary.count_by_pet_bucket(sale_days, *window)) == rows_of(R.count_by_pet_bucket(sales, "PolicyNumber", *window))
    crm, crm_days = facts["crm"]
    assert rows_of(summary.policy_month_trend(crm_days, *window, policy_type="no")) == rows_of(
        R.policy_month_trend(crm, *window, date_basis="QuoteStartDate", policy_type="no"))


def test_wrapping_day_windows(spark, facts):
    _, days = facts["quote"]
    fact = facts["quote"][0]
    for first, last in ((20, 10), (31, 1), (5, 5)):
        got = days.agg(F.sum(summary.wrapped("rows", first, last))).first()[0]
        from ledgerlight.functions import periods as K
        assert got == fact.where(K.day_window_wrap("CreatedDate", first, last)).count()


def test_only_changed_months_are_rebuilt(spark, tmp_path):
    fact, days = str(tmp_path / "fact"), str(tmp_path / "days")
    d = dt.datetime
    schema = "CountryCode string, Brand string, PetType string, SaleMethod string, PolicyNumber string, CreatedDate timestamp_ntz"

    def rows(items):
        return spark.createDataFrame([("NZ", "B", "Cat", "Web", p, t) for p, t in items], schema)

    def counts():
        return sorted((r.created_month, r.rows[30], r.counted[30]) for r in spark.read.parquet(days).collect())

    kw = {"work_dir": str(tmp_path / "w")}
    load.windowed_replace(spark, rows([("p", d(2024, m, 3)) for m in (1, 2, 3, 5)] + [(None, d(2024, 1, 9))]), fact, "2024-01-01", "2024-05-31", **kw)
    assert summary.refresh(spark, "sales", fact, days, **kw) == ["2024-01", "2024-02", "2024-03", "2024-05"]
    assert counts() == [("2024-01", 2, 1), ("2024-02", 1, 1), ("2024-03", 1, 1), ("2024-05", 1, 1)]
    # A month shrinks, another is emptied, one is new; the rest is not touched.
    load.windowed_replace(spark, rows([("q", d(2024, 4, 1))]), fact, "2024-02-01", "2024-04-30", **kw)
    load.windowed_replace(spark, rows([]), fact, "2024-01-05", "2024-01-31", **kw)
    assert summary.refresh(spark, "sales", fact, days, **kw) == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert counts() == [("2024-01", 1, 1), ("2024-04", 1, 1), ("2024-05", 1, 1)]
    assert summary.refresh(spark, "sales", fact, days, **kw) == []


def test_summary_of_a_catalog_table(spark, tmp_path):
    from ledgerlight.plans.warehouse import Warehouse
    wh = Warehouse(spark, str(tmp_path), database="default")
    table = "Sales"
    src = Sources(spark, SF001)
    spark.sql(f"DROP TABLE IF EXISTS default.{table}")
    load.windowed_replace(spark, src["sales_wh"], wh.path(table), *config.FULL_WINDOW, location=f"{tmp_path}/{table}")
    assert wh.summarise("sales")
    window = ("2001-01-15", "2001-06-20")
    assert rows_of(summary.count_by_pet_bucket(wh.days("sales"), *window)) == rows_of(
        R.count_by_pet_bucket(wh.read(table, *window), "PolicyNumber", *window))
    plan = wh.read(table, *window)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(6 paths)" in plan  # the catalog gives six months
    spark.sql(f"DROP TABLE default.{table}")

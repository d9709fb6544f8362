"""Every API endpoint function runs on the fixture, JSON and download forms."""

import datetime as dt
import os
import tempfile

import pytest

from ledgerlight import config
from ledgerlight.plans import api
from ledgerlight.sources.adapters import Sources
from fixture_paths import SF001

AS_OF = config.AS_OF


@pytest.fixture(scope="module")
def tables(spark):
    src = Sources(spark, SF001)
    return api.Tables(spark, quote=src["quote_wh"], sales=src["sales_wh"], free_policy=src["free_wh"],
                      crm=src["crm_wh"])


def _count(result):
    if isinstance(result, dict):
        return {k: v.count() for k, v in result.items()}
    return result.count()


JSON_CALLS = [
    ("quote_summary", {}), ("quote_data", {"skip": 5, "limit": 20}),
    ("quote_summary_by_pet_type", {}), ("quote_data_by_pet_type", {"quoteStatus": "Live"}),
    ("quote_conversion_summary", {}), ("quote_conversion_data", {}),
    ("quote_rmth_same_period_summary", {}), ("quote_rmth_same_period_report", {}),
    ("sales_summary", {}), ("sales_data", {}), ("sales_by_pet_type", {}), ("free_policy_sales", {}),
    ("free_policy_data", {}), ("sales_rmth_same_period", {}), ("policy_summary", {}),
    ("policy_data", {"extracted_at": dt.datetime(2001, 7, 10)}),
]


@pytest.mark.parametrize("name,kwargs", JSON_CALLS)
def test_json_endpoints_run(tables, name, kwargs):
    out = getattr(api, name)(tables, as_of=AS_OF, **kwargs)
    counts = _count(out)
    assert counts is not None


DOWNLOADS = ["quote_data", "quote_data_by_pet_type", "quote_conversion_data",
             "quote_rmth_same_period_report", "sales_data", "free_policy_data", "policy_data"]


@pytest.mark.parametrize("name", DOWNLOADS)
def test_download_endpoints_write_csv(tables, name):
    out_dir = tempfile.mkdtemp(prefix="ll-api-")
    path = getattr(api, name)(tables, start_date="2001-01-01", end_date="2001-06-30", download=True,
                              as_of=AS_OF, out_dir=out_dir)
    assert path.startswith(out_dir) and path.endswith(".csv")
    assert any(f.endswith(".csv") for f in os.listdir(path))


def test_defaults_follow_as_of(tables):
    kpi = api.quote_summary(tables, as_of="2001-06-20")["summary"]
    direct = api.quote_summary(tables, start_date="2001-06-01", end_date="2001-06-20", as_of="2001-06-20")
    assert kpi.collect() == direct["summary"].collect()


def test_summary_matches_registered_query(spark, tables):
    import __spark_entry__ as E
    want = E.queries()["kpi_summary"](spark, SF001).collect()
    got = api.quote_summary(tables, "2001-06-05", "2001-06-20", country_codes="africa, Asia ,EUROPE",
                            pet_types="Cat,dog,bbc,unknown", as_of=AS_OF)["summary"].collect()
    assert got == want


def test_endpoints_on_a_loaded_warehouse(spark):
    """ETL the sales fact into a warehouse, then call an endpoint on it."""
    from ledgerlight.plans.warehouse import Warehouse
    from ledgerlight.sources.adapters import RegionalSources
    root = tempfile.mkdtemp(prefix="ll-wh-")
    regions = {code: RegionalSources(spark, SF001, key) for code, key in config.FIXTURE_REGION_KEYS.items()}
    Warehouse(spark, root).load("sales", regions, *config.FULL_WINDOW, AS_OF, config.FIXTURE_DOMAIN)
    t = api.Tables.from_warehouse(spark, root)
    assert t.sales is not None and t.quote is None
    out = api.sales_by_pet_type(t, "2001-01-01", "2001-06-30", country_codes="nz,au", as_of=AS_OF)
    plan = out["summary"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan
    assert out["total"].collect()[0][0] == out["summary"].agg({"value": "sum"}).collect()[0][0]


def test_crm_loader_feeds_the_policy_endpoints(spark):
    from ledgerlight.plans.warehouse import Warehouse
    from ledgerlight.sources.adapters import RegionalSources
    root = tempfile.mkdtemp(prefix="ll-wh-crm-")
    regions = {code: RegionalSources(spark, SF001, key) for code, key in config.FIXTURE_REGION_KEYS.items()}
    res = api.etl_crm(spark, regions, f"{root}/CRM", "1994-01-01", "2002-12-31", as_of=AS_OF,
                      domain=config.FIXTURE_DOMAIN)
    assert res.rows_loaded > 0 and res.rows_rejected == 0
    t = api.Tables.from_warehouse(spark, root)
    trend = api.policy_summary(t, "2001-01-15", "2001-06-20", regions="UK,NZ", historical_months=7,
                               as_of=AS_OF)
    page = api.policy_data(t, "2001-01-15", "2001-06-20", historical_months=7, as_of=AS_OF,
                           extracted_at=dt.datetime(2001, 7, 10))
    assert trend.count() > 0 and page.count() > 0
    assert set(r.CountryCode for r in page.select("CountryCode").distinct().collect()) <= set(
        config.FIXTURE_REGION_KEYS)


def test_api_lists_come_back_in_reference_order(tables):
    names = [r.name for r in api.quote_summary_by_pet_type(tables, "2001-01-15", "2001-06-20",
                                                            as_of=AS_OF)["summary"].collect()]
    assert names == sorted(names, reverse=True)
    periods = [r.period for r in api.quote_summary(tables, "2001-06-05", "2001-06-20",
                                                   as_of=AS_OF)["graphData"].collect()]
    assert periods == sorted(periods) and len(periods) == 13
    values = [r.value for r in api.free_policy_sales(tables, "2001-01-15", "2001-06-20",
                                                     as_of=AS_OF)["by_status"].collect()]
    assert values == sorted(values, reverse=True)


@pytest.mark.parametrize("snapshots", [False, True])
def test_etl_route_loads_three_facts(spark, snapshots):
    from ledgerlight.sources.adapters import RegionalSources
    root = tempfile.mkdtemp(prefix="ll-route-")
    regions = {code: RegionalSources(spark, SF001, key) for code, key in config.FIXTURE_REGION_KEYS.items()}
    targets = {k: f"{root}/{t}" for k, t in (("quote", "Quote"), ("sales", "Sales"),
                                             ("free_policies", "FreePolicySales"))}
    res = api.etl_route(spark, regions, targets, "1994-01-01", "2002-12-31", as_of=AS_OF,
                      domain=config.FIXTURE_DOMAIN, snapshots=snapshots)
    assert set(res) == {"quote", "sales", "free_policies"}
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("ll_snap_")]
    t = api.Tables.from_warehouse(spark, root)
    for kind, df in (("quote", t.quote), ("sales", t.sales), ("free_policies", t.free_policy)):
        assert df.count() == res[kind].rows_loaded > 0


def test_cluster_settings_fill_only_unset_keys(spark):
    from ledgerlight.session import CLUSTER_SETTINGS, apply_cluster_settings
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64m")
    apply_cluster_settings(spark)
    assert spark.conf.get(key) == "64m"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in (
        CLUSTER_SETTINGS["spark.sql.files.maxPartitionBytes"], "134217728b", "128m")

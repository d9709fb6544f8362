"""Plan tests: the physical plans have the shape the design promises."""

from ledgerlight.registry import REGISTRY
import ledgerlight.queries  # noqa: F401

from fixture_paths import SF001


def _plan(spark, name):
    df = REGISTRY[name].spark(spark, SF001)
    df.collect()  # final AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_top1_dedupe_is_partial_before_shuffle(spark):
    p = _plan(spark, "fact_quote_a")
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_breakdown_is_one_scan_with_expand(spark):
    df = REGISTRY["breakdown_share"].spark(spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in p and "Union" not in p
    # lineitem (the fact's driving table) is scanned once for all three breakdowns.
    assert p.count("FileScan parquet [l_orderkey") == 1


def test_page_uses_top_k_not_global_window(spark):
    for name in ("listing_quote", "listing_policy"):
        df = REGISTRY[name].spark(spark, SF001)
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in p
        assert "Window [count" not in p


def test_window_filter_pushed_to_scan(spark):
    df = REGISTRY["quote_date_window"].spark(spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in p and "o_orderdate" in p


def test_policy_choice_is_partial_top1_before_the_quote_join(spark):
    from ledgerlight.plans import facts
    from ledgerlight.sources.adapters import Sources
    src = Sources(spark, SF001)
    best = facts.best_policy_per_quote(src, src["quote_src"])
    best.collect()
    p = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


def test_sales_fact_counts_cancellations_before_one_join(spark):
    """Cancellations are read once, and counted before the shuffle."""
    from ledgerlight import config
    from ledgerlight.plans import facts
    from ledgerlight.sources.adapters import Sources
    src = Sources(spark, SF001)
    cancels = spark.createDataFrame([(1, 1, None)], "id long, policy_id long, created_date timestamp_ntz")
    tables = {t: src[t] for t in ("policy_full_src", "client_src", "policy_src", "product_dim", "quote_src", "user_dim")}
    df = facts.sales_fact_a({**tables, "cancel_src": cancels}, *config.FULL_WINDOW, config.FIXTURE_DOMAIN)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("LogicalRDD") + p.count("LocalRelation") == 1 and "LeftAnti" not in p and "pc_n" in p


def test_reports_prune_months_on_loader_tables(spark):
    """A report given a loader-written table adds the month range itself."""
    import os
    import tempfile
    from ledgerlight import config
    from ledgerlight.operators import load
    from ledgerlight.plans import reports as R
    from ledgerlight.sources.adapters import Sources
    work = tempfile.mkdtemp(prefix="ll-prune-report-")
    target = os.path.join(work, "Sales")
    sales = Sources(spark, SF001)["sales_wh"]
    load.windowed_replace(spark, sales, target, *config.FULL_WINDOW, work_dir=work)
    table = spark.read.parquet(target)
    got = R.count_by_pet_bucket(table, "PolicyNumber", *config.WIDE_WINDOW)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and "2001-01" in plan
    want = R.count_by_pet_bucket(sales, "PolicyNumber", *config.WIDE_WINDOW)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

"""Named sources: JDBC options, view schemas, production product ids."""

import dataclasses
import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixture_paths import SF001
from ledgerlight import config
from ledgerlight.functions import periods as K
from ledgerlight.plans import api, facts
from ledgerlight.sources import production
from ledgerlight.sources.adapters import RegionalSources
from ledgerlight.sources.snapshots import Snapshot, as_many_partitions
from ledgerlight.sources.registry import SourceSpec, day_depths, source_registry, split_window


def test_jdbc_tables_are_read_in_parts():
    spec = source_registry({"uk": {"format": "jdbc", "url": "jdbc:none", "parts": {"Quote": ("Id", 1, 9_000_000, 200)}}})["uk"]
    assert spec.jdbc_options("Quote") == {
        "url": "jdbc:none", "dbtable": "Quote", "partitionColumn": "Id", "lowerBound": "1",
        "upperBound": "9000000", "numPartitions": "200"}
    assert "partitionColumn" not in spec.jdbc_options("Client")


def test_views_cover_what_the_facts_read(spark):
    import re
    from pathlib import Path
    used = set(re.findall(r'src\["(\w+)"\]', Path(facts.__file__).read_text()))
    assert used <= set(production.VIEWS)
    for view in production.VIEWS:
        assert len(production.source_schema(view)) == len(production.VIEWS[view][1])


def test_the_domain_is_never_assumed(spark):
    with pytest.raises(TypeError):
        facts.quote_fact_a({}, "2024-01-01", "2024-01-02")
    with pytest.raises(TypeError):
        api.etl_quote(spark, {}, "/tmp/x")


def _source(spark, tmp_path, rows):
    """A named source with the given rows (dicts by source column) per table."""
    for view, (table, _) in production.VIEWS.items():
        schema = production.source_schema(view)
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows.get(table, [])]
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    return production.SourceViews(spark, SourceSpec("uk", path=str(tmp_path)))


def test_production_ids_and_the_activity_question(spark, tmp_path):
    day = dt.datetime(2024, 1, 10, 9)
    quote = dict(CreatedDate=day, QuoteDate=day, FirstName="Ann", LastName="Lee", PetName="Rex", CreatedBy=1,
                 QuoteSaveFrom=2, HearAboutUs=1, Email="a@b.c")
    src = _source(spark, tmp_path, {
        "Quote": [dict(quote, Id=1, ProductId=2053), dict(quote, Id=2, ProductId=3, PetName="Tom"),
                  dict(quote, Id=3, ProductId=999)],
        "HearAboutUs": [dict(Id=1, Name="Web")], "VuePetType": [dict(PetType_ID=4, PetTypeName="Cat")],
        "QuoteQuestionAnswer": [dict(Id=10, QuoteId=1, QuestionId=33024), dict(Id=11, QuoteId=1, QuestionId=5)],
        "QuoteQuestionAnswerDetail": [dict(QuoteQuestionAnswerId=10, QuestionAnswer="7, 8"),
                                      dict(QuoteQuestionAnswerId=11, QuestionAnswer="9")],
        "QuestionDetail": [dict(Id=i, QuestionDetailName=n) for i, n in ((7, "Walk"), (8, "Groom"), (9, "Other"))]})
    got = {r["Id"]: r for r in facts.quote_dedupe_set_based(src, "2024-01-01", "2024-01-31", config.PET_DOMAIN).collect()}
    assert {i: (r["PetType"], r["BB_Activity"]) for i, r in got.items()} == {1: ("BB_Commercial", "Groom, Walk"), 2: ("Cat", None)}
    rows = facts.quote_fact_b(src, "2024-01-01", "2024-01-31", config.PET_DOMAIN).collect()
    assert sorted(r["PetType"] for r in rows) == ["BB_Commercial", "Cat"]


def test_free_policies_fall_back_to_the_activitys_pet(spark, tmp_path):
    day = dt.datetime(2024, 1, 10)
    policy = dict(IsFreeProduct=True, CreatedDate=day)
    activity = dict(TransactionTypeId=1, ProductId=2, QuoteId=5)
    src = _source(spark, tmp_path, {
        "Policy": [dict(policy, Id=i, PolicyNumber=n, PetName=p) for i, n, p in (
            (1, "P1", None), (2, "P2", None), (3, "P3", "Rex"), (4, "P4", "Test"), (5, "test5", "Rex"))],
        "PolicyActivity": [dict(activity, PolicyId=1, PetName="Rex"), dict(activity, PolicyId=2, PetName="TEST"),
                           dict(activity, PolicyId=3, PetName="TEST"), dict(activity, PolicyId=4, PetName="Rex"),
                           dict(activity, PolicyId=5, PetName="Rex")],
        "Product": [dict(Id=2, ProductCode="DOG")], "Quote": [dict(Id=5, SubAgentId=6)],
        "SubAgent": [dict(Id=6, Email="x@y.z", Name="Agent")]})
    rows = facts.free_fact_a(src, "2024-01-01", "2024-01-31", config.PET_DOMAIN).collect()
    assert sorted(r["PolicyNumber"] for r in rows) == ["P1", "P3"]


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    """A region of the fixture in a source's own tables."""
    root = tmp_path_factory.mktemp("named")
    region = RegionalSources(spark, SF001, config.FIXTURE_REGION_KEYS["UK"])
    for view in ("policy_full_src", "policy_src", "cancel_src", "client_src", "product_dim", "quote_src", "user_dim",
                 "hear_about_dim", "pet_type_dim", "policy_status_dim", "sub_agent_dim", "state_dim", "breed_dim"):
        table, columns = production.VIEWS[view]
        region[view].select(*[F.col(c).cast(kind).alias(name) for c, (name, kind) in columns.items()]).write.parquet(f"{root}/{table}.parquet")
    return production.SourceViews(spark, SourceSpec("uk", path=str(root)))


WINDOW = config.FULL_WINDOW
BUILDERS = {"sales_a": facts.sales_fact_a, "sales_b": facts.sales_fact_b, "free_a": facts.free_fact_a, "free_b": facts.free_fact_b}


@pytest.mark.parametrize("name", BUILDERS)
def test_reduced_sources_give_the_same_facts(spark, named, monkeypatch, name):
    def rows():
        return sorted(map(repr, BUILDERS[name](named, *WINDOW, config.FIXTURE_DOMAIN).collect()))

    assert named.reduces
    cut = rows()
    monkeypatch.setattr(type(named), "reduces", False)
    assert cut == rows() and cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_window_keys_are_broadcast_to_the_scans(spark, named):
    plan = _plan(facts.sales_fact_b(named, *WINDOW, config.FIXTURE_DOMAIN))
    for column in ("policy_id", "id"):
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan, column
    assert plan.count("LeftSemi") == 3  # cancellations, clients, quotes


def test_many_window_keys_become_bloom_filters_on_the_scans(spark, named):
    """With keys too large to broadcast, the scans of cancellations, clients and
    quotes are filtered by what the window holds."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = facts.sales_fact_b(named, *WINDOW, config.FIXTURE_DOMAIN)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows = sorted(map(repr, df.collect()))
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert rows == sorted(map(repr, facts.sales_fact_b(named, *WINDOW, config.FIXTURE_DOMAIN).collect()))
    filtered = [line for line in plan.splitlines() if "might_contain" in line]
    assert len(filtered) >= 3 and "bloom_filter_agg" in plan
    # Below the aggregate of the cancellations, on their scan.
    at = plan.index("PolicyId#", plan.index("Aggregate"))
    assert "might_contain" in plan[:at + 2000]


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_window_predicates_part_the_rows_evenly(spark, named, parts):
    """Every row of the window meets one predicate, and the parts are of like
    size, also with a day that holds a third of all rows."""
    import duckdb
    hot = dt.datetime(2001, 3, 1)
    stamps = [r[0] for r in named["quote_src"].select("created_date").collect()]
    n = len(stamps) // 2
    stamps += [hot + dt.timedelta(seconds=(i * 86_399) // n) for i in range(n)]
    rows = spark.createDataFrame([(t,) for t in stamps], "CreatedDate timestamp_ntz")
    start, end = "2000-12-15", "2001-06-20"
    inside = rows.where(K.in_window("CreatedDate", start, end))
    spec = SourceSpec("uk", format="jdbc", window_parts={"Quote": parts}, depths={"Quote": day_depths(inside, "CreatedDate")})
    predicates = spec.window_predicates("Quote", "CreatedDate", start, end)
    assert parts // 2 < len(predicates) <= parts
    table = inside.toArrow()
    con = duckdb.connect()
    con.register("windowed", table)
    counts = [con.execute(f"SELECT count(*) FROM windowed WHERE {p}").fetchone()[0] for p in predicates]
    assert sum(counts) == table.num_rows
    assert max(counts) <= table.num_rows / parts + 8
    assert con.execute("SELECT count(*) FROM windowed WHERE " + " OR ".join(f"({p})" for p in predicates)).fetchone()[0] == table.num_rows


def test_window_without_known_days_is_cut_evenly():
    pieces = split_window("2024-01-01", "2024-01-10", 5)
    assert [(b - a).days for a, b in pieces] == [2] * 5
    assert pieces[0][0] == dt.datetime(2024, 1, 1) and pieces[-1][1] == dt.datetime(2024, 1, 11)
    assert split_window("2024-01-01", "2024-01-01", 1) == [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))]
    assert len(split_window("2024-01-01", "2024-01-01", 4)) == 4


def test_jdbc_windows_are_read_by_predicates():
    """The options a window read hands to Spark; no database is asked."""
    asked = {}

    class Reader:
        read = property(lambda self: self)

        def jdbc(self, url, table, **kw):
            asked.update(kw, url=url, table=table)

    spec = source_registry({"uk": {"format": "jdbc", "url": "jdbc:none", "user": "x", "window_parts": {"Quote": 2}}})["uk"]
    spec.read_window(Reader(), "Quote", "CreatedDate", "2024-01-01", "2024-01-04")
    assert asked == {"url": "jdbc:none", "table": "Quote", "properties": {"user": "x"}, "predicates": [
        "CreatedDate >= '2024-01-01T00:00:00' AND CreatedDate < '2024-01-03T00:00:00'",
        "CreatedDate >= '2024-01-03T00:00:00' AND CreatedDate < '2024-01-05T00:00:00'"]}


def test_windows_of_file_sources_reach_the_scan(named):
    plan = _plan(named.window("quote_src", "created_date", "2001-01-15", "2001-06-20"))
    assert "PushedFilters: [IsNotNull(CreatedDate), GreaterThanOrEqual(CreatedDate" in plan


def test_collated_domains(spark, named):
    """Clean keys give the same customer view by bytes and by collation."""
    nocase = dataclasses.replace(config.FIXTURE_DOMAIN, collation=config.NOCASE_KEYS)
    a, b = (facts.crm_fact(named, "2001-01-01", "2001-03-01", dt.date(2001, 7, 10), d).where("PolicyNumber is not null")
            .select("QuoteNumber", "PolicyNumber") for d in (config.FIXTURE_DOMAIN, nocase))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


class Counted(dict):
    """A source that counts how often each view is read."""

    def __init__(self, src):
        super().__init__()
        self.src, self.reads = src, Counter()

    def __getitem__(self, view):
        self.reads[view] += 1
        return self.src[view]


def exchanged_scans(plan):
    """Bucketed tables whose rows are shuffled right behind their scan, and all
    bucketed tables, from an executed plan's text."""
    shuffled, seen, above = set(), set(), []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        above = [(d, op) for d, op in above if d < depth]
        found = re.search(r"ll_snap_\w+?_((?:quote|client|policy_full|policy|cancel)_src)", line)
        if "FileScan" in line and found:
            seen.add(found.group(1))
            for _, op in reversed(above):
                if "Join" in op or "Window" in op or "Aggregate" in op:
                    break
                if "Exchange hashpartitioning" in op:
                    shuffled.add(found.group(1))
        above.append((depth, line))
    return shuffled, seen


def test_snapshots_read_each_source_once_and_join_without_moving_it(spark, named, tmp_path):
    src = Counted(named.src if hasattr(named, "src") else named)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.sources.bucketing.autoBucketedScan.enabled": "true", "spark.sql.maxMetadataStringLength": "4000",
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "500"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with Snapshot(spark, src) as snap, as_many_partitions(spark, snap.buckets):
            plans = {}
            for name, build in (("sales", facts.sales_fact_b), ("quote", facts.quote_fact_a), ("free", facts.free_fact_b)):
                df = build(snap, *WINDOW, config.FIXTURE_DOMAIN)
                got = sorted(map(repr, df.collect()))
                assert got == sorted(map(repr, build(named, *WINDOW, config.FIXTURE_DOMAIN).collect()))
                plans[name] = build(snap, *WINDOW, config.FIXTURE_DOMAIN)._jdf.queryExecution().executedPlan().toString()
            assert max(src.reads.values()) == 1
            shuffled, seen = exchanged_scans(plans["sales"])
            assert {"policy_full_src", "policy_src", "cancel_src", "client_src", "quote_src"} <= seen and not shuffled, plans["sales"]
            shuffled, seen = exchanged_scans(plans["quote"])
            assert {"quote_src", "policy_src", "client_src"} <= seen and not shuffled & {"quote_src", "policy_src", "client_src"}
            names = list(snap.tables.values())
        assert not any(spark.catalog.tableExists(t) for t in names)
    finally:
        for k in conf:
            spark.conf.unset(k)

"""Load tests: reload is idempotent, emptied months disappear, rows outside
the window and NULL-date rows survive or are rejected, cuts are counted."""

import csv
import datetime as dt
import io
import os
import tempfile
import uuid

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators import claims, load, paging
from ledgerlight.sources import schemas
from ledgerlight.streaming import csv_export


def _rows(spark, items):
    return spark.createDataFrame(items, "k string, CreatedDate timestamp_ntz, v int")


def test_windowed_replace_semantics(spark):
    work = tempfile.mkdtemp(prefix="ll-load-")
    target = os.path.join(work, "T")
    d = dt.datetime
    first = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 2, 5), 1), ("c", d(2024, 2, 20), 1),
                          ("d", d(2024, 3, 1), 1), ("e", d(2024, 3, 31, 23, 59), 1)])
    r1 = load.windowed_replace(spark, first, target, "2024-01-01", "2024-03-31", work_dir=work)
    assert r1.rows_loaded == 5 and r1.rows_rejected == 0
    # Reload Feb 1..Mar 15 with one changed March row and no February rows; a
    # NULL-date row and a row outside the window are rejected.
    new = _rows(spark, [("d", d(2024, 3, 1), 2), ("x", None, 9), ("y", d(2024, 5, 1), 9)])
    r2 = load.windowed_replace(spark, new, target, "2024-02-01", "2024-03-15", work_dir=work)
    assert r2.rows_loaded == 1 and r2.rows_rejected == 2
    assert r2.months_emptied == ["2024-02"]
    got = sorted((r.k, r.v) for r in spark.read.parquet(target).collect())
    assert got == [("a", 1), ("d", 2), ("e", 1)]
    assert not os.path.exists(os.path.join(target, "created_month=2024-02"))
    # Idempotent: the same reload again changes nothing.
    load.windowed_replace(spark, new, target, "2024-02-01", "2024-03-15", work_dir=work)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == got


def test_read_window_prunes_partitions(spark):
    work = tempfile.mkdtemp(prefix="ll-prune-")
    target = os.path.join(work, "T")
    d = dt.datetime
    load.windowed_replace(spark, _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 2, 5), 1)]),
                          target, "2024-01-01", "2024-02-28", work_dir=work)
    df = load.read_window(spark, target, "2024-02-01", "2024-02-10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan
    assert "PushedFilters: [IsNotNull(CreatedDate), GreaterThanOrEqual(CreatedDate" in plan
    assert [r.k for r in df.collect()] == ["b"]


def test_conform_and_truncation_report(spark):
    schema = T.StructType([T.StructField("name", T.StringType(), True, {"max_length": 3}),
                           T.StructField("ts", T.TimestampNTZType(), True),
                           T.StructField("missing", T.IntegerType(), True)])
    df = spark.createDataFrame([("abcdef", dt.datetime(2024, 2, 29, 10, 0, 0, 123456), "x"),
                                ("ab", None, "y")], "name string, ts timestamp_ntz, extra string")
    out = load.conform(df, schema)
    assert out.columns == ["name", "ts", "missing"]
    rows = out.collect()
    assert rows[0].name == "abc" and rows[0].ts == dt.datetime(2024, 2, 29, 10, 0, 0, 123000)
    rep = load.truncation_report(df, schema).collect()
    assert [(r.column_name, r.cut_rows, r.max_seen) for r in rep] == [("name", 1, 6)]
    assert load.column_mismatch(df, schema) == [("extra", "extra"), ("missing", "missing")]


def test_table_name_guard():
    assert load.valid_table_name("FreePolicySales")
    assert not load.valid_table_name("bad name;")
    assert not load.valid_table_name("x" * 129)


def test_export_filename():
    assert csv_export.export_filename("sales.csv", "2024-01-01", "2024-01-31") == \
        "sales_2024-01-01_to_2024-01-31.csv"  # N16: suffix removed, not characters
    assert csv_export.export_filename("policy.csv", "a", "b", (5, 20)) == "policy_d5-20_a_to_b.csv"


def _joined(spark, path):
    names = [r["name"] for r in csv_export.manifest(spark, path).orderBy("position").collect()]
    return b"".join(open(os.path.join(path, n), "rb").read() for n in names)


def test_csv_roundtrip_keeps_blanks_and_booleans(spark):
    work = tempfile.mkdtemp(prefix="ll-csv-")
    df = spark.createDataFrame([(" a ", True, 'q"x'), (None, False, "p")], "s string, b boolean, t string")
    path = csv_export.write_csv(df, os.path.join(work, "out.csv"))
    back = csv_export.read_csv(spark, path, df.schema).collect()
    assert sorted((r.s, r.b, r.t) for r in back if r.s) == [(" a ", "True", 'q"x')]
    assert b'"q""x"' in _joined(spark, path)


def test_csv_files_in_order_are_python_csv(spark, tmp_path):
    """The files in manifest order are byte for byte what Python writes."""
    texts = ["plain", "", None, "a,b", 'say "x"', "two\nlines", "cr\rhere", " blanks ", '"', "#hash", "ü,ö", "\\back", "'", ";", "\t"]
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), None]
    rows = [(i, texts[i % len(texts)], stamps[i % 3], [True, False, None][i % 3 - 1], dt.date(2020, 1, 1 + i % 9))
            for i in range(200)]
    df = spark.createDataFrame(rows, "`no,1` int, s string, t timestamp_ntz, b boolean, d date").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = csv_export.write_csv(df, str(tmp_path / "x.csv"), paging.asc("no,1"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = io.StringIO()
    out = csv.writer(want, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows(rows)
    assert _joined(spark, path) == want.getvalue().encode()
    files = csv_export.manifest(spark, path).collect()
    assert sum(f["rows"] for f in files) == 200 and len(files) > 2
    back = csv_export.read_csv(spark, path, df.schema).orderBy("`no,1`").collect()
    assert [r["s"] for r in back] == [r[1] or None for r in rows]
    one = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    path = csv_export.write_csv(one, str(tmp_path / "one.csv"))
    assert sorted(_joined(spark, path).split(b"\n")) == sorted([b"s", b'""', b'""', b"x", b""])
    none = csv_export.write_csv(one.where("s = 'nothing'"), str(tmp_path / "none.csv"))
    assert _joined(spark, none) == b"s\n"


def test_schemas_lengths():
    assert schemas.max_length(schemas.QUOTE["FullName"]) is None
    assert schemas.max_length(schemas.with_widths(schemas.QUOTE, {"FullName": 40})["FullName"]) == 40
    assert schemas.max_length(schemas.QUOTE["Address"]) is None


def test_target_schema_reflection(spark):
    work = tempfile.mkdtemp(prefix="ll-schema-")
    target = os.path.join(work, "T")
    assert load.target_schema(spark, target) is None
    d = dt.datetime
    load.windowed_replace(spark, _rows(spark, [("a", d(2024, 1, 10), 1)]), target,
                          "2024-01-01", "2024-01-31", work_dir=work)
    sch = load.target_schema(spark, target)
    assert [f.name for f in sch.fields] == ["k", "CreatedDate", "v", "created_month"]
    assert load.target_schema(spark, "no_such_table_xyz") is None


def test_source_registry_and_fan_in(spark):
    from ledgerlight.sources.registry import SourceSpec, fan_in
    spec = SourceSpec("fixture", path="/root/testdata/sf0.001")
    region = spec.read(spark, "region")
    assert region.count() == 5
    a = region.select("r_regionkey").withColumn("CountryCode", F.lit("NZ"))
    b = region.select("r_regionkey", "r_name")
    u = fan_in([a, b])
    assert sorted(u.columns) == ["CountryCode", "r_name", "r_regionkey"]
    assert u.count() == 10 and u.where(F.col("r_name").isNull()).count() == 5


def test_regional_sources_partition_the_fixture(spark):
    """The five regional slices are disjoint and together hold every
    customer, order and order line exactly once."""
    from ledgerlight import config
    from ledgerlight.sources.adapters import RegionalSources, Sources
    whole = Sources(spark, "/root/testdata/sf0.001")
    regions = [RegionalSources(spark, "/root/testdata/sf0.001", k)
               for k in config.FIXTURE_REGION_KEYS.values()]
    for table, key in (("customer", "c_custkey"), ("orders", "o_orderkey"),
                       ("lineitem", "l_orderkey")):
        parts = [r[table] for r in regions]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        assert union.count() == whole[table].count()
        assert union.select(key).distinct().count() == whole[table].select(key).distinct().count()


def test_named_source_registry():
    from ledgerlight.sources.registry import source_registry
    reg = source_registry({"nz": {"path": "/root/testdata/sf0.001"},
                           "mis": {"format": "parquet", "path": "/warehouse"}})
    assert reg["nz"].format == "parquet" and reg["mis"].path == "/warehouse"
    try:
        source_registry({"xx": {}})
        assert False, "unknown source accepted"
    except KeyError:
        pass


def test_windowed_replace_into_a_catalog_table(spark):
    work = tempfile.mkdtemp(prefix="ll-table-")
    table = "ll_test_sales_" + os.path.basename(work).replace("-", "_").lower()
    d = dt.datetime
    first = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 2, 5), 1), ("c", d(2024, 3, 1), 1)])
    load.windowed_replace(spark, first, table, "2024-01-01", "2024-03-31", work_dir=work,
                          location=os.path.join(work, "T"))
    new = _rows(spark, [("c", d(2024, 3, 1), 2)])
    r = load.windowed_replace(spark, new, table, "2024-02-01", "2024-03-31", work_dir=work)
    assert r.months_emptied == ["2024-02"]
    assert sorted((x.k, x.v) for x in spark.table(table).collect()) == [("a", 1), ("c", 2)]
    parts = [x[0] for x in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    assert "created_month=2024-02" not in parts
    spark.sql(f"DROP TABLE {table}")


def test_windowed_replace_matches_a_brute_force_model(spark):
    """Random loads and reloads against the plain model: after a reload of
    [start, end], the table is (old rows outside the window) + (new rows in it)."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    day = st.integers(min_value=0, max_value=120).map(lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(
        days=n, hours=n % 24))
    row = st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), day), st.integers(0, 9))

    @settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
    @given(old=st.lists(row, max_size=12), new=st.lists(row, max_size=12),
           lo=st.integers(0, 120), span=st.integers(0, 60))
    def check(old, new, lo, span):
        work = tempfile.mkdtemp(prefix="ll-prop-")
        target = os.path.join(work, "T")
        full = ("2023-12-01", "2024-06-30")
        load.windowed_replace(spark, _rows(spark, old), target, *full, work_dir=work)
        s = dt.date(2024, 1, 1) + dt.timedelta(days=lo)
        e = s + dt.timedelta(days=span)
        load.windowed_replace(spark, _rows(spark, new), target, s, e, work_dir=work)

        def inside(ts, a, b):
            return ts is not None and a <= ts.date() <= b

        lo_full, hi_full = dt.date(2023, 12, 1), dt.date(2024, 6, 30)
        model = [r for r in old if inside(r[1], lo_full, hi_full) and not inside(r[1], s, e)]
        model += [r for r in new if inside(r[1], s, e)]
        try:
            got = [(r.k, r.CreatedDate, r.v) for r in spark.read.parquet(target).collect()]
        except Exception:  # no target, or every month emptied: no data file left
            got = []
        assert sorted(got, key=repr) == sorted(model, key=repr)

    check()
    # The all-emptied case explicitly: old rows only inside the window, nothing new.
    work = tempfile.mkdtemp(prefix="ll-prop-empty-")
    target = os.path.join(work, "T")
    load.windowed_replace(spark, _rows(spark, [("a", dt.datetime(2024, 2, 3), 1)]), target,
                          "2024-02-01", "2024-02-29", work_dir=work)
    r = load.windowed_replace(spark, _rows(spark, []), target, "2024-02-01", "2024-02-29",
                              work_dir=work)
    assert r.months_emptied == ["2024-02"]
    r = load.windowed_replace(spark, _rows(spark, [("b", dt.datetime(2024, 2, 4), 2)]), target,
                              "2024-02-01", "2024-02-29", work_dir=work)
    assert [(x.k, x.v) for x in spark.read.parquet(target).collect()] == [("b", 2)]


def test_reload_keeps_the_targets_columns(spark, tmp_path):
    target, work = str(tmp_path / "t"), str(tmp_path / "w")
    d = dt.datetime
    old = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 1, 25), 2)]).selectExpr("*", "'kept' AS extra")
    load.windowed_replace(spark, old, target, "2024-01-01", "2024-01-31", work_dir=work)
    new = _rows(spark, [("c", d(2024, 1, 11), 3)]).selectExpr("*", "1 AS unknown")
    load.windowed_replace(spark, new, target, "2024-01-01", "2024-01-15", work_dir=work)
    got = {r[0]: r["extra"] for r in spark.read.parquet(target).select(old.columns[0], "extra").collect()}
    assert got == {"b": "kept", "c": None} and "unknown" not in spark.read.parquet(target).columns
    assert not any(p for p in (tmp_path / "w").glob("_staging/*/*") if p.name != "_claims")


def test_a_stopped_reload_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    target, work = str(tmp_path / "t"), str(tmp_path / "w")
    d = dt.datetime
    old = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 1, 25), 2), ("c", d(2024, 2, 3), 3)])
    load.windowed_replace(spark, old, target, "2024-01-01", "2024-02-28", work_dir=work)
    publish = load._publish

    def stop(spark, target, folders, emptied, location, check):
        load._delete(spark, f"{target}/{load.MONTH_COL}=2024-01")  # between delete and rename
        raise RuntimeError("stopped")

    monkeypatch.setattr(load, "_publish", stop)
    with pytest.raises(RuntimeError):
        load.windowed_replace(spark, _rows(spark, [("n", d(2024, 1, 11), 9)]), target, "2024-01-01", "2024-01-15", work_dir=work)
    monkeypatch.setattr(load, "_publish", publish)
    # Another window is loaded next: the first one is completed before it.
    load.windowed_replace(spark, _rows(spark, [("z", d(2024, 2, 4), 5)]), target, "2024-02-01", "2024-02-10", work_dir=work)
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == ["b", "n", "z"]


def _loaded(spark, work, target):
    """A target after two loads, the second of one of its months."""
    d = dt.datetime
    old = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 1, 25), 2), ("c", d(2024, 2, 20), 3)])
    load.windowed_replace(spark, old, target, "2024-01-01", "2024-02-28", work_dir=work)
    new = _rows(spark, [("n", d(2024, 1, 11), 9), ("m", d(2024, 2, 9), 9), ("x", None, 9)])
    load.windowed_replace(spark, new, target, "2024-01-01", "2024-02-10", work_dir=work)
    return sorted(r[0] for r in spark.read.parquet(target).collect())


def test_months_of_a_path_are_written_once(spark, tmp_path, monkeypatch):
    """The target shows the files that the load has written, not copies."""
    written, write = {}, load._write_months

    def noted(*args):
        found, folder = write(*args), args[2]
        written.update({m: load.names_in(spark, f"{folder}/{load.MONTH_COL}={m}") for m in found})
        return found

    monkeypatch.setattr(load, "_write_months", noted)
    target = str(tmp_path / "t")
    assert _loaded(spark, str(tmp_path / "w"), target) == ["c", "m", "n"]
    for month in ("2024-01", "2024-02"):
        assert load.names_in(spark, f"{target}/{load.MONTH_COL}={month}") == written[month]


def test_months_that_cannot_be_moved_are_copied(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(load, "_move", lambda *args: False)
    assert _loaded(spark, str(tmp_path / "w"), str(tmp_path / "t")) == ["c", "m", "n"]


def test_a_load_stopped_between_two_months_is_finished(spark, tmp_path, monkeypatch):
    target, work, move = str(tmp_path / "t"), str(tmp_path / "w"), load._move
    d, moved = dt.datetime, []

    def stop(*args):
        if moved:
            raise RuntimeError("stopped")
        moved.append(args)
        return move(*args)

    rows = _rows(spark, [("a", d(2024, 1, 10), 1), ("b", d(2024, 2, 3), 2)])
    monkeypatch.setattr(load, "_move", stop)
    with pytest.raises(RuntimeError):
        load.windowed_replace(spark, rows, target, "2024-01-01", "2024-02-28", work_dir=work)
    monkeypatch.setattr(load, "_move", move)
    load.windowed_replace(spark, _rows(spark, [("z", d(2024, 3, 4), 5)]), target, "2024-03-01", "2024-03-10", work_dir=work)
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == ["a", "b", "z"]


def test_regions_share_one_reading(spark, tmp_path):
    """Equal and null keys: each region's tables are those of its semi joins,
    and no region reads the whole tables."""
    from ledgerlight.sources.adapters import RegionalSources, RegionalTables

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "A"), (1, "B")], "r_regionkey int, r_name string")
    put("nation", [(1, "a", 0), (2, "b", 1), (3, "c", 0), (3, "c", 1), (3, "c", 1), (None, "d", 0), (4, "e", None), (5, "f", 7)],
        "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(10, "x", 1), (10, "x", 1), (10, "y", 2), (11, "z", 3), (None, "n", 1), (12, "o", None), (13, "p", 4), (14, "q", 5)],
        "c_custkey long, c_name string, c_nationkey int")
    put("orders", [(100, 10), (100, 10), (100, 11), (101, 11), (102, 12), (None, 10), (103, None), (104, 14), (105, 10)],
        "o_orderkey long, o_custkey long")
    put("lineitem", [(100, 1), (100, 1), (101, 2), (102, 3), (None, 4), (104, 5), (105, 6), (999, 7)], "l_orderkey long, l_linenumber int")
    tables = RegionalTables(spark, str(tmp_path), [0, 1, 2])
    for key in (0, 1, 2):
        alone, shared = (RegionalSources(spark, str(tmp_path), key, t) for t in (None, tables))
        for name in ("customer", "orders", "lineitem", "nation"):
            want, got = (sorted(map(repr, src[name].collect())) for src in (alone, shared))
            assert got == want and shared[name].columns == alone[name].columns
        assert len(shared["lineitem"].collect()) == {0: 4, 1: 4, 2: 0}[key]
        assert not any(f"{tmp_path}/lineitem" in f for f in shared["lineitem"].inputFiles())


def test_window_on_another_date_is_not_pruned(spark, tmp_path):
    target, work = str(tmp_path / "t"), str(tmp_path / "w")
    rows = spark.createDataFrame([(dt.datetime(2024, 2, 2), dt.datetime(2024, 1, 31))], "QuoteStartDate timestamp_ntz, QuoteCreatedDate timestamp_ntz")
    load.windowed_replace(spark, rows, target, "2024-02-01", "2024-02-28", date_col="QuoteStartDate", work_dir=work)
    assert load.month_source(spark.read.parquet(target).schema) == "QuoteStartDate"
    assert load.read_window(spark, target, "2024-01-01", "2024-01-31", "QuoteCreatedDate").count() == 1
    assert load.read_window(spark, target, "2024-02-01", "2024-02-28").count() == 1
    with pytest.raises(ValueError):
        load.windowed_replace(spark, rows, target, "2024-01-01", "2024-01-31", date_col="QuoteCreatedDate", work_dir=work)


def test_csv_keeps_fractions(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 0, 123000),), (dt.datetime(2024, 1, 1, 10),)], "t timestamp_ntz")
    path = csv_export.write_csv(rows, str(tmp_path / "x"), paging.asc("t"))
    assert sorted(r["t"] for r in csv_export.read_csv(spark, path, rows.schema).collect()) == sorted(r["t"] for r in rows.collect())
    lines = {r[0] for r in spark.read.text(path).collect()}
    assert {"2024-01-01 10:00:00", "2024-01-01 10:00:00.123000"} <= lines


@pytest.mark.parametrize("kind", ["path", "table"])
@pytest.mark.parametrize("second", [("2024-01-16", "2024-02-10"), ("2024-01-05", "2024-01-12"), ("2024-03-01", "2024-03-31")])
def test_two_loads_at_a_time_keep_each_others_rows(spark, tmp_path, monkeypatch, kind, second):
    """A second load begins and ends while the first has written its rows but
    not yet published them; their windows share a month, or cut one another."""
    work = str(tmp_path / "w")
    target = str(tmp_path / "t") if kind == "path" else "ll_two_" + uuid.uuid4().hex[:12]
    d = dt.datetime
    old = [("a", d(2024, 1, 3), 0), ("b", d(2024, 1, 11), 0), ("c", d(2024, 1, 20), 0), ("e", d(2024, 2, 5), 0), ("f", d(2024, 2, 20), 0)]
    load.windowed_replace(spark, _rows(spark, old), target, "2024-01-01", "2024-03-31", work_dir=work, location=str(tmp_path / "loc"))
    first = ("2024-01-10", "2024-01-15")
    mine, others = [("n", d(2024, 1, 14), 1)], [("m", dt.datetime.fromisoformat(second[0]), 2)]
    real, state = load._claim, {"calls": 0}

    def claim(*args):
        state["calls"] += 1
        if state["calls"] == 2:  # the first load's publishing
            load.windowed_replace(spark, _rows(spark, others), target, *second, work_dir=work)
        return real(*args)

    monkeypatch.setattr(load, "_claim", claim)
    result = load.windowed_replace(spark, _rows(spark, mine), target, *first, work_dir=work)
    assert bool(result.months_restaged) == (second[0] < "2024-02-01")

    def inside(row, window):
        return window[0] <= row[1].date().isoformat() <= window[1]

    model = [r for r in old if not inside(r, second)] + others
    model = [r for r in model if not inside(r, first)] + mine
    rows = spark.table(target) if kind == "table" else spark.read.parquet(target)
    assert sorted(tuple(r)[:3] for r in rows.select("k", "CreatedDate", "v").collect()) == sorted(model)


def test_a_table_shows_the_old_or_the_new_month_at_any_time(spark, tmp_path, monkeypatch):
    table, d = "ll_swap_" + uuid.uuid4().hex[:12], dt.datetime
    rows = [("a", d(2024, m, 10), m) for m in (1, 2, 3)]
    load.windowed_replace(spark, _rows(spark, rows), table, "2024-01-01", "2024-03-31", work_dir=str(tmp_path / "w"), location=str(tmp_path / "t"))
    seen, real = [], load._point

    def look():
        spark.catalog.refreshTable(table)
        seen.append(sorted((r.k, r.v) for r in spark.table(table).collect()))

    def point(*args):
        look()
        real(*args)
        look()

    monkeypatch.setattr(load, "_point", point)
    new = [("b", d(2024, m, 12), m) for m in (1, 2, 3)]
    reader = spark.table(table)  # a query that began before
    load.windowed_replace(spark, _rows(spark, new), table, "2024-01-01", "2024-03-31", work_dir=str(tmp_path / "w"))
    assert len(seen) == 6 and seen[0] == [("a", 1), ("a", 2), ("a", 3)] and seen[-1] == [("b", 1), ("b", 2), ("b", 3)]
    assert all([v for _, v in state] == [1, 2, 3] for state in map(lambda s: sorted(s, key=lambda r: r[1]), seen))
    assert reader.count() == 3
    assert load.drop_unused_months(spark, table) == [] and len(load.drop_unused_months(spark, table, older_than=-1)) == 3
    spark.catalog.refreshTable(table)
    assert spark.table(table).count() == 3


def test_stopped_swap_of_a_table_is_finished(spark, tmp_path, monkeypatch):
    table, work, d = "ll_stop_" + uuid.uuid4().hex[:12], str(tmp_path / "w"), dt.datetime
    load.windowed_replace(spark, _rows(spark, [("a", d(2024, m, 10), m) for m in (1, 2)]), table, "2024-01-01", "2024-02-28", work_dir=work)
    real, calls = load._point, []

    def point(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        real(*args)

    monkeypatch.setattr(load, "_point", point)
    with pytest.raises(RuntimeError):
        load.windowed_replace(spark, _rows(spark, [("b", d(2024, m, 12), m) for m in (1, 2)]), table, "2024-01-01", "2024-02-28", work_dir=work)
    monkeypatch.setattr(load, "_point", real)
    load.windowed_replace(spark, _rows(spark, [("c", d(2024, 5, 1), 5)]), table, "2024-05-01", "2024-05-31", work_dir=work)
    assert sorted((r.k, r.v) for r in spark.table(table).collect()) == [("b", 1), ("b", 2), ("c", 5)]


def test_claims_are_exclusive_and_fenced(spark, tmp_path):
    folder = str(tmp_path / "c")
    with claims.Claim(spark, folder) as first:
        first.check()
        with pytest.raises(TimeoutError):
            with claims.Claim(spark, folder, wait=0.2, poll=0.05):
                pass
        # One that has not been heard of is passed over, and finds out.
        with claims.Claim(spark, folder, stale_after=-1) as other:
            other.check()
            with pytest.raises(claims.ClaimLost):
                first.check()
    with claims.Claim(spark, folder) as third:
        assert third.generation == 3


def test_catalog_widths_are_reflected_cut_and_counted(spark, tmp_path):
    table, d = "ll_width_" + uuid.uuid4().hex[:12], dt.datetime
    spark.sql(f"CREATE TABLE {table} (Name VARCHAR(3), Code CHAR(2), Free STRING, CreatedDate TIMESTAMP_NTZ, {load.MONTH_COL} STRING) "
              f"USING parquet PARTITIONED BY ({load.MONTH_COL}) LOCATION '{tmp_path / 'loc'}'")
    schema = load.target_schema(spark, table)
    assert [schemas.max_length(f) for f in schema.fields] == [3, 2, None, None, None]
    rows = spark.createDataFrame([("abcdef", "xyz", "long text", d(2024, 1, 1)), ("ab", "q", None, d(2024, 1, 2))],
                                 "Name string, Code string, Free string, CreatedDate timestamp_ntz")
    report = {r.column_name: r.cut_rows for r in load.truncation_report(rows, schema).collect()}
    assert report == {"Name": 1, "Code": 1}
    load.windowed_replace(spark, rows, table, "2024-01-01", "2024-01-31", work_dir=str(tmp_path / "w"))
    got = sorted((r.Name, r.Code.rstrip(), r.Free) for r in spark.table(table).collect())
    assert got == [("ab", "q", None), ("abc", "xy", "long text")]

"""Semantics tests on literal frames (N3-N8, N10, C-rules, D-rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import columns as C
from ledgerlight.functions import filters as D


def test_normalize_input():
    assert D.normalize_input(None) == []
    assert D.normalize_input("all") == []
    assert D.normalize_input("ALL,x") == []
    assert D.normalize_input("a, A ,b") == ["a", "b"]
    assert D.normalize_input(["x", " y ", ""]) == ["x", "y"]


def test_normalize_regions():
    assert D.normalize_regions("all") == []
    assert D.normalize_regions("AT,DE") == ["AT", "DE"]
    assert D.normalize_regions(["all", "UK"]) == ["all", "UK"]


def test_page_and_sort_guards():
    assert D.page_args("3", 10_000) == (3, 10_000)
    for bad in ((-5, 10), (0, 0), (3, 50_000)):
        with pytest.raises(ValueError):
            D.page_args(*bad)
    assert D.sort_direction("asc") == "ASC" and D.sort_direction("sideways") == "DESC"
    assert D.choose_date_basis("Nope") == "QuoteCreatedDate"
    assert D.status_list("all") is None and D.status_list([" Active ", ""]) == ["Active"]
    assert D.free_policy_list("YES") == ["Yes"] and D.free_policy_list("maybe") is None


TEXT = ["None", "none", None, "", "  ", "BB_Commercial", "bbXcom", "Contact Center", "contact_center", " WEB "]


def _text(spark):
    return spark.createDataFrame([(t,) for t in TEXT], "t string")


def test_like_is_case_insensitive_and_underscore_wildcard(spark):
    rows = _text(spark).select("t", C.not_converted("t").alias("nc"),
                               D.pet_filter("t", ["bbc"]).alias("bb")).collect()
    got = {r.t: (r.nc, r.bb) for r in rows}
    assert got["None"][0] and got["none"][0] and got[None][0]
    assert got["BB_Commercial"][1] and got["bbXcom"][1]  # '_' matches one character (N4)
    assert not got["Contact Center"][1]


def test_unknown_pet_tokens_give_no_filter():
    assert D.pet_filter("t", ["parrot"]) is None


def test_method_normalisation(spark):
    rows = _text(spark).select("t", C.normalised_method("t").alias("m")).collect()
    got = {r.t: r.m for r in rows}
    assert got["Contact Center"] == "phone" and got["contact_center"] == "phone"
    assert got[" WEB "] == "web" and got[None] == "none"


def test_concat_null_rules(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    rows = df.select(C.full_name("x", "y").alias("f"), C.address("x", "y").alias("a")).collect()
    assert rows[0].f is None and rows[0].a == "a, "
    assert rows[1].f == "a b" and rows[1].a == "a, b"


def test_exclusion_null_policy(spark):
    df = spark.createDataFrame([(None,), ("Test",), ("ok",)], "n string")
    drop = [r.n for r in df.where(D.not_like_any("n", ["%test%"], keep_null=False)).collect()]
    keep = [r.n for r in df.where(D.not_like_any("n", ["%test%"], keep_null=True)).collect()]
    assert drop == ["ok"] and sorted(keep, key=str) == [None, "ok"]


def test_quote_status_grid(spark):
    as_of = dt.date(2001, 7, 10)
    vals = [None, dt.datetime(2001, 7, 9), dt.datetime(2001, 7, 10), dt.datetime(2001, 7, 11)]
    df = spark.createDataFrame([(e, s) for e in vals for s in vals], "e timestamp_ntz, s timestamp_ntz")
    for r in df.select("e", "s", C.quote_status("e", "s", as_of).alias("q")).collect():
        if r.e is None and r.s is None:
            assert r.q is None
        elif r.e is not None and dt.datetime(2001, 7, 10) > r.e:
            assert r.q == "Lapsed"
        else:
            assert r.q == "Live"


def test_count_if_empty_is_zero(spark):
    df = spark.createDataFrame([(1,)], "x int").where("x > 5")
    assert df.agg(F.count_if(F.col("x") > 0)).collect()[0][0] == 0


def test_first_nonzero_and_bucket(spark):
    df = spark.createDataFrame([(0, None, 3), (0, 0, 0), (5, 1, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(C.first_nonzero("a", "b", "c")).collect()] == [3, None, 5]
    t = spark.createDataFrame([("Big Cat",), (None,), ("bb-com",)], "p string")
    got = [r[0] for r in t.select(C.report_pet_bucket("p")).collect()]
    assert got == ["Cat", "Others", "BB"]

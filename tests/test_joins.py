"""Skew-safe fan-out join: same rows as a left outer join, hot key included."""

from pyspark.sql import functions as F

from ledgerlight.operators.joins import fanout_left_join


def test_fanout_left_join_equals_left_join_with_hot_key(spark):
    left = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x")).alias("l")
    # Key 1 holds a third of the right side; keys >= 2000 have no match; one NULL key.
    right = (spark.range(0, 6000)
             .select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id") % 2000).alias("rk"),
                     F.col("id").alias("rv"))
             .union(spark.createDataFrame([(None, -1)], "rk long, rv long")))
    got = fanout_left_join(left, right, "l.k", "rk").select("l.k", "x", "rk", "rv")
    want = left.join(right, F.col("l.k") == F.col("rk"), "left").select("l.k", "x", "rk", "rv")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "LeftAnti" in plan

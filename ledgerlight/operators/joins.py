"""Skew-safe fan-out joins.

``left LEFT JOIN right`` where ``right`` fans out (quote -> policy activities,
policy -> cancellations) has its heavy side on the right.  AQE's skew-join
handling splits an oversized shuffle partition only on a side it may
replicate against: for a left outer join that is the left side, so a single
hot key on the right (one quote with a third of all activities) would still
land in one task.

``fanout_left_join`` returns exactly the rows of the left outer join, built
from two joins AQE can split:

* ``left INNER JOIN right`` -- inner joins may split a skewed partition on
  either side;
* ``left LEFT ANTI JOIN distinct(right keys)`` -- the left rows without a
  match; the right side is pre-aggregated to one row per key (partial
  distinct runs map-side), so a hot key costs one row, not a third of the
  table.

The union of the two has the right columns NULL for unmatched rows, like the
outer join.  Both branches shuffle ``left`` by the same key, so Spark reuses
that exchange instead of reading ``left`` twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared folder and read back.  The planner
    then knows its real size: small key sets are broadcast, larger ones become
    runtime filters, and the rows are not worked out again for each use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/_keys/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reduced(rows: DataFrame, row_key: str, keys: DataFrame, key: str, selective: Column) -> DataFrame:
    """The rows whose key is among ``keys`` -- what a later join on that key
    would keep of them, cut off before ``rows`` are shuffled: by a broadcast if
    the keys are few, else by the bloom filter that Spark builds of a key side
    with a ``selective`` condition."""
    found = keys.where(selective & F.col(key).isNotNull()).select(F.col(key).alias("_rk"))
    return rows.join(found, F.col(row_key) == F.col("_rk"), "left_semi")


def fanout_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Same result as ``left.join(right, left[left_key] == right[right_key], "left")``.

    Column names of the two sides must be distinct (qualified aliases are
    kept on ``left``)."""
    matched = left.join(right, F.col(left_key) == F.col(right_key), "inner")
    keys = right.select(F.col(right_key).alias("_fk")).where(F.col("_fk").isNotNull()).distinct()
    unmatched = left.join(keys, F.col(left_key) == F.col("_fk"), "left_anti")
    filler = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    # Positional union: both sides are (left columns, right columns) in order,
    # and left may legitimately carry duplicate names under different aliases.
    return matched.union(unmatched.select("*", *filler))

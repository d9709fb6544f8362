"""Reshape operators (L1, L2, L4) and calendar alignment.

Keyed totals (L3/F11) come out of ``reports.method_totals`` directly.

All inputs here are aggregates (one row per month x method at most), so the
pivot and calendar join move a few hundred rows; the heavy lifting happened in
the partial aggregation before them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, index: str, pivot_col: str, value_col: str,
              values: Sequence[str]) -> DataFrame:
    """L1/L2: ``index x pivot`` sum with zero fill.  Explicit pivot values
    avoid the extra distinct job and guarantee the columns exist."""
    wide = df.groupBy(index).pivot(pivot_col, list(values)).agg(F.sum(value_col))
    return wide.select(index, *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v)
                                for v in values])


def align_to_calendar(calendar: DataFrame, agg: DataFrame, on: str,
                      fill: Sequence[str]) -> DataFrame:
    """Calendar left join aggregate; missing months become 0."""
    other = [c for c in agg.columns if c != on]
    joined = calendar.join(agg, on, "left")
    return joined.select(on, *[
        (F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in fill else F.col(c)).alias(c)
        for c in other])


def split_level(df: DataFrame, level: str, level_col: str = "level") -> DataFrame:
    """L4: one part of a tagged union."""
    return df.where(F.col(level_col) == level).drop(level_col)

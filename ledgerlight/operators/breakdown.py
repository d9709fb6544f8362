"""Several independent breakdowns in one pass.

``GROUPING SETS`` computes every breakdown from one scan (Expand + one
partial/final aggregate) instead of one scan per ``UNION ALL`` branch.  The
level comes from ``grouping_id()``, not from NULL tests, because a NULL group
key is a legal group.  The share window runs over the aggregate (a handful of
rows per level), never over the base rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def breakdown_with_share(df: DataFrame, levels: Sequence[tuple[str, str]],
                         value_col: str = "value", share_col: str = "PctOfTotal",
                         name_col: str = "name", level_col: str = "level") -> DataFrame:
    """F10 + G9: ``levels`` is ``[(level_label, column), ...]``.

    Output ``(level, name, value, PctOfTotal)`` with
    ``PctOfTotal = CAST(100.0 * value / NULLIF(SUM(value) OVER level, 0) AS DECIMAL(5,1))``.
    """
    cols = [c for _, c in levels]
    n = len(cols)
    g = df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias(value_col), F.grouping_id().alias("_gid"))
    # grouping_id bit i (from the left, most significant) is 1 when column i
    # is aggregated away; exactly one column is grouped per set.
    level_expr = None
    name_expr = None
    for i, (label, c) in enumerate(levels):
        gid = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        test = F.col("_gid") == gid
        level_expr = F.when(test, F.lit(label)) if level_expr is None else level_expr.when(test, F.lit(label))
        name_expr = (F.when(test, F.col(c).cast("string")) if name_expr is None
                     else name_expr.when(test, F.col(c).cast("string")))
    tagged = g.select(level_expr.alias(level_col), name_expr.alias(name_col),
                      F.col(value_col).cast("bigint").alias(value_col))
    total = F.sum(value_col).over(Window.partitionBy(level_col))
    share = (F.lit(100).cast("decimal(20,6)") * F.col(value_col) / F.nullif(total, F.lit(0)))
    return tagged.withColumn(share_col, share.cast("decimal(5,1)"))


def grand_total(df: DataFrame, level: str, value_col: str = "value",
                level_col: str = "level", out_col: str = "total") -> DataFrame:
    """sum over one level of the breakdown (0 when empty)."""
    return df.where(F.col(level_col) == level).agg(
        F.coalesce(F.sum(value_col), F.lit(0)).cast("bigint").alias(out_col))

"""CSV-list lookup.

The reference resolves a comma-separated id list per row with a correlated
scalar subquery.  Here it is set-based: explode the tokens, ``try_cast`` them
(bad tokens become NULL and drop out of the inner join), join the name
dimension, and ``listagg`` the names per row in a fixed order.  Every step is a
built-in; the aggregation groups by the row key, so it is a normal
hash-partitioned aggregate with map-side partial merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_ids(df: DataFrame, key: str, csv_col: str, id_col: str = "token_id") -> DataFrame:
    """J22 set form: one row per parsable token (``STRING_SPLIT`` + ``TRY_CAST``)."""
    return (df.select(key, F.explode(F.split(F.col(csv_col), ",")).alias("_tok"))
              .select(key, F.expr("try_cast(trim(_tok) AS INT)").alias(id_col))
              .where(F.col(id_col).isNotNull()))


def lookup_list(df: DataFrame, key: str, csv_col: str, dim: DataFrame, dim_id: str,
                dim_name: str, out_col: str = "names", sep: str = ", ",
                distinct_ids: bool = True) -> DataFrame:
    """``key -> 'name1, name2'`` in name order.

    ``distinct_ids`` mirrors ``Id IN (list)``: an id listed twice contributes
    its name once."""
    ids = explode_ids(df, key, csv_col)
    if distinct_ids:
        ids = ids.distinct()
    named = ids.join(dim.select(F.col(dim_id).alias("token_id"), F.col(dim_name).alias("_name")),
                     "token_id", "inner")
    sep_sql = "'" + sep.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return named.groupBy(key).agg(
        F.expr(f"listagg(_name, {sep_sql}) WITHIN GROUP (ORDER BY _name)").alias(out_col))

"""Keep-one-row-per-key operators.

``latest_per_key`` is ``row_number() OVER (PARTITION BY keys ORDER BY ...) = 1``.
Spark plans the ``rn = 1`` filter as ``WindowGroupLimit``: a partial top-1 runs
on every map task before the shuffle, so even a key holding a third of all
rows ships one row per map partition, not the whole group.  The caller must
give a *total* order (unique last key) so the kept row is deterministic (N11).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collated(c: str | Column, collation: str | None) -> Column:
    """A text key that is compared under a collation (None: by bytes)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.collate(c, collation) if collation else c


def latest_per_key(df: DataFrame, keys: Sequence[str | Column],
                   order: Sequence[Column], rank_col: str = "_rn",
                   keep_rank: bool = False, collation: str | None = None) -> DataFrame:
    """Keep the first row of each key group under ``order``; text keys
    given by name are equal if the collation says so."""
    if collation:
        keys = [collated(k, collation) if isinstance(k, str) and isinstance(df.schema[k].dataType, T.StringType) else k
                for k in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) == 1)
    return out if keep_rank else out.drop(rank_col)


def normalised_key(c: str | Column) -> Column:
    """G1 key normalisation: ``lower(trim(c))``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def existence_flag(df: DataFrame, df_key: str, other: DataFrame, other_key: str,
                   flag: str = "_exists") -> DataFrame:
    """``CASE WHEN EXISTS (SELECT 1 FROM other WHERE other.k = df.k)``.

    The other side is reduced to its distinct keys (partial aggregation runs
    map-side), then left-joined, so ``df`` rows never fan out."""
    keys = other.select(F.col(other_key).alias("_ek")).where(F.col("_ek").isNotNull()).distinct()
    return (df.join(keys, F.col(df_key) == F.col("_ek"), "left")
              .withColumn(flag, F.col("_ek").isNotNull())
              .drop("_ek"))

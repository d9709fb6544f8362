"""Source registry (A1, A2, A5, A6): named regional sources -> reader options.

The reference holds six named database connections; here a source is a
format plus options (a JDBC URL and credentials come from the cluster's
configuration, never from code).  In tests every region reads the fixture
parquet folder.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import periods as K


def split_window(start, end, parts: int, depths: Mapping[dt.date, int] | None = None) -> list[tuple[dt.datetime, dt.datetime]]:
    """The days ``start .. end`` as at most ``parts`` half-open stretches of time
    with about equally many rows each, by the rows per day in ``depths``: a day
    it does not list has none, but days before its first and after its last are
    not known yet and count as the average.  A day that alone is more than a
    part is cut by the clock."""
    s, e = K.to_date(start), K.to_date(end)
    days = [s + dt.timedelta(days=i) for i in range((e - s).days + 1)]
    first, last = (min(depths), max(depths)) if depths else (None, None)
    usual = sum(depths.values()) / ((last - first).days + 1) if depths else 1.0
    weight = [float(depths.get(d, 0)) if depths and first <= d <= last else usual for d in days]
    total = sum(weight) or 1.0
    cuts, passed = [], 0.0
    for i in range(1, parts):
        want, at, before = total * i / parts, 0, 0.0
        while at < len(days) - 1 and before + weight[at] < want:
            before += weight[at]
            at += 1
        share = (want - before) / weight[at] if weight[at] else 0.0
        day = dt.datetime.combine(days[at], dt.time())
        # Whole days, unless the day holds more than a part by itself.
        if weight[at] * parts <= total:
            cuts.append(day + dt.timedelta(days=round(share)))
        else:
            cuts.append(day + dt.timedelta(seconds=int(86_400 * min(share, 1.0))))
    begin, finish = dt.datetime.combine(s, dt.time()), dt.datetime.combine(e, dt.time()) + dt.timedelta(days=1)
    edges = [begin, *sorted(c for c in set(cuts) if begin < c < finish), finish]
    return list(zip(edges, edges[1:]))


def day_depths(rows: DataFrame, date_col: str) -> dict[dt.date, int]:
    """Rows per day, as known from an earlier load: the depths of the next one."""
    counts = rows.where(F.col(date_col).isNotNull()).groupBy(F.to_date(date_col).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return {r["day"]: r["n"] for r in counts.collect()}


@dataclass(frozen=True)
class SourceSpec:
    name: str
    format: str = "parquet"
    path: str | None = None
    options: dict = field(default_factory=dict)
    # Table -> (whole-number column, lowest, highest value, parts): a JDBC table
    # listed here is read in parts, by as many tasks.
    parts: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)
    # Tasks that read the window of a JDBC table, by table, and (optional) how
    # many rows its days have.
    window_parts: dict[str, int] = field(default_factory=dict)
    depths: dict[str, dict[dt.date, int]] = field(default_factory=dict)

    def window_predicates(self, table: str, column: str, start, end) -> list[str]:
        """Conditions that part the window of a table among tasks: every row of
        the window meets exactly one."""
        pieces = split_window(start, end, self.window_parts.get(table, 1), self.depths.get(table))
        return [f"{column} >= '{a:%Y-%m-%dT%H:%M:%S}' AND {column} < '{b:%Y-%m-%dT%H:%M:%S}'" for a, b in pieces]

    def read_window(self, spark: SparkSession, table: str, column: str, start, end) -> DataFrame:
        """The rows of ``[start, end]`` on a date column.  A JDBC table is read
        by one query per predicate; a file source gets the plain bounds, which
        its reader prunes and pushes down."""
        if self.format == "jdbc":
            options = {k: v for k, v in self.options.items() if k != "url"}
            return spark.read.jdbc(self.options["url"], table, properties=options,
                                   predicates=self.window_predicates(table, column, start, end))
        return self.read(spark, table).where(K.in_window(column, start, end))

    def jdbc_options(self, table: str) -> dict[str, str]:
        out = {**self.options, "dbtable": table}
        if table in self.parts:
            column, low, high, n = self.parts[table]
            out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
                    "numPartitions": str(n)}
        return out

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if self.format == "jdbc":
            return spark.read.format("jdbc").options(**self.jdbc_options(table)).load()
        return spark.read.format(self.format).options(**self.options).load(f"{self.path}/{table}.{self.format}")


def fan_in(frames: list[DataFrame]) -> DataFrame:
    """Concat by column name; columns missing in a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# A5: the six named connections -- five regional operational sources and the
# reporting warehouse ("mis").
SOURCE_NAMES = ["nz", "au", "uk", "at", "de", "mis"]


def source_registry(options_by_name: dict[str, dict]) -> dict[str, SourceSpec]:
    """Named sources from cluster configuration: ``{"nz": {"format": "jdbc",
    "url": ..., ...}, ...}``.  Unknown names are refused."""
    out = {}
    for name, opts in options_by_name.items():
        if name not in SOURCE_NAMES:
            raise KeyError(f"unknown source {name!r}")
        opts = dict(opts)
        out[name] = SourceSpec(name, opts.pop("format", "parquet"), opts.pop("path", None),
                               parts=opts.pop("parts", {}), window_parts=opts.pop("window_parts", {}),
                               depths=opts.pop("depths", {}), options=opts)
    return out


def read_bound(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A parameterised read.  Values are bound as named parameter markers
    (``:start``), never formatted into the text; ``frames`` binds
    ``{name}`` placeholders to DataFrames."""
    return spark.sql(sql, args=args or {}, **frames)


"""The warehouse as month-partitioned tables under one root.

With ``database`` the tables are catalog tables that lie under the root, whose
months are swapped by pointer; without, they are plain folders.  A load also
brings the table's day summary in line (``plans.summary``).

The ETL (``plans.etl``) writes each fact to ``<root>/<Table>`` partitioned by
``created_month``; reports read it through ``Warehouse.read``, which adds the
month predicate so the scan prunes partitions (a filter on the date column
alone prunes nothing on a table partitioned by a derived month).  The read
window must cover the report's own range (13-month series, look-backs); the
report's date predicates then cut inside the pruned months.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ledgerlight import config
from ledgerlight.functions import periods as K
from ledgerlight.operators import load
from ledgerlight.plans import etl, summary

TABLES = {"quote": "Quote", "sales": "Sales", "free_policies": "FreePolicySales", "crm": "CRM"}


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, database: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.database = database

    def path(self, table: str) -> str:
        """What loads and reads take: the catalog name, or the folder."""
        if not load.valid_table_name(table):
            raise ValueError(f"invalid table name {table!r}")
        return f"{self.database}.{table}" if self.database else f"{self.root}/{table}"

    def load(self, kind: str, sources, start, end, as_of,
             domain: config.Domain, summarise: bool = False) -> load.LoadResult:
        """M8 for one fact into this warehouse, and (``summarise``) its day
        summary for the months that the load has changed."""
        location = f"{self.root}/{TABLES[kind]}" if self.database else None
        result = etl.run_etl(self.spark, kind, sources, start, end, as_of,
                             self.path(TABLES[kind]), domain, location=location)
        if summarise:
            self.summarise(kind)
        return result

    def summarise(self, kind: str) -> list[str]:
        """Rebuild the day summary of months that have changed; those months."""
        return summary.refresh(self.spark, kind, self.path(TABLES[kind]), f"{self.root}/{TABLES[kind]}Days")

    def days(self, kind: str) -> DataFrame:
        """The day summary of one fact (quotes: ``open_quotes`` beside it)."""
        return self.spark.read.parquet(f"{self.root}/{TABLES[kind]}Days")

    def open_quotes(self) -> DataFrame:
        return self.spark.read.parquet(summary.open_target(f"{self.root}/{TABLES['quote']}Days"))

    def read(self, table: str, start, end, date_col: str | None = None) -> DataFrame:
        """Rows of ``[start, end]`` on ``date_col`` (default: the column that the
        table's months come from, and then month partitions are pruned)."""
        return load.read_window(self.spark, self.path(table), start, end, date_col)

    def read_series(self, table: str, end, months: int = config.SERIES_MONTHS,
                    date_col: str | None = None) -> DataFrame:
        """Rows of the ``months`` calendar months ending in ``end``'s month."""
        lo, hi = K.month_anchors(end, months)
        return self.read(table, lo, hi - dt.timedelta(days=1), date_col)

"""Regional snapshots: each source table read once, written by join key.

A full load runs three extractions over the same sources.  A snapshot copies
each table that they ask for once, when it is first asked for.  The large ones
are bucketed and sorted by the key that they are joined on, so a join reads them
bucket by bucket and only the window's rows move; two large tables that share
the key (policies and their cancellations, quotes and their activities) meet
without moving at all.  The copies are catalog tables in the shared folder;
``close`` drops them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.operators import load
from ledgerlight.session import shared_dir

# Large views and the key of their own joins.  Activities are joined from the
# policy (their id is the policy's) and from the quote, so they are kept twice.
BUCKETS: dict[str, str] = {"quote_src": "id", "client_src": "id", "policy_full_src": "id", "policy_src": "id",
                           "cancel_src": "policy_id"}

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def as_many_partitions(spark: SparkSession, buckets: int):
    """While this holds, shuffles begin with as many partitions as the snapshots
    have buckets: with more, Spark would move the bucketed tables as well."""
    before = spark.conf.get(INITIAL, None)
    spark.conf.set(INITIAL, str(buckets))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(INITIAL)
        else:
            spark.conf.set(INITIAL, before)


class Snapshot(Mapping):
    """The views of one source, as copies made for one full load."""

    def __init__(self, spark: SparkSession, src: Mapping[str, DataFrame], buckets: int | None = None):
        self.spark, self.src = spark, src
        # Fewer buckets than shuffle partitions would be shuffled again.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"ll_snap_{uuid.uuid4().hex[:16]}"
        self.tables: dict[tuple[str, str | None], str] = {}

    def _copy(self, view: str, key: str | None) -> str:
        if (view, key) not in self.tables:
            table = f"{self.name}_{view}" + (f"_{key}" if key else "")
            # A second key is copied from the first copy: the source is read once.
            rows = self[view] if key not in (None, BUCKETS.get(view)) else self.src[view]
            if key:  # a file a bucket
                rows = rows.repartition(self.buckets, key)
            writer = rows.write.format("parquet").option("path", f"{shared_dir(self.spark)}/_snapshots/{table}")
            if key:
                writer = writer.bucketBy(self.buckets, key).sortBy(key)
            writer.saveAsTable(table)
            self.tables[view, key] = table
        return self.tables[view, key]

    def by(self, view: str, key: str) -> DataFrame:
        """A view bucketed by a key of its own."""
        return self.spark.table(self._copy(view, key))

    def __getitem__(self, view: str) -> DataFrame:
        return self.spark.table(self._copy(view, BUCKETS.get(view)))

    def __iter__(self) -> Iterator[str]:
        return iter(self.src)

    def __len__(self) -> int:
        return len(self.src)

    def close(self) -> None:
        for table in self.tables.values():
            where = load.table_location(self.spark, table)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            load._delete(self.spark, where)
        self.tables.clear()

    def __enter__(self) -> "Snapshot":
        return self

    def __exit__(self, *error) -> None:
        self.close()

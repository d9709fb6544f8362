"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import time
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.session import shared_dir

# Java character class of the blanks that part words.
BLANKS = r"[\x20\x09-\x0D]+"
# Upper-case and lower-case ASCII letters, for byte and SQL translation.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: Column) -> Column:
    """Maximal runs of non-blank characters, in order."""
    return F.array_remove(F.split(col, BLANKS), "")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), those whose key hash
    lies below a cut found from the row count; the caller limits exactly."""
    n, slots = df.count(), 1 << 30
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(slots)) < int(slots * min(1.0, 1.2 * most / n)))


# Seconds from one collection of the driver's garbage to the next, at least.
COLLECT_S = 15
_collected = {"at": 0.0}


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage, if it was not asked to lately.

    Spark frees the broadcasts and shuffles of ended steps when the collector
    finds that nothing refers to them, and the heap shrinks to what is in use;
    a JVM that is left alone may grow it to its limit first."""
    if time.monotonic() - _collected["at"] >= COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected["at"] = time.monotonic()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared folder and read it back:
    lineage ends there, and a lost executor costs only its own reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
# Rows handed to a Python task at a time where the session has Spark's default
# (10,000): whole texts are long, and a task holds a batch several times over.
BATCH_CONF, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def with_code(df: DataFrame) -> DataFrame:
    """``df``, after making this package importable in the session's Python
    workers (once a session; Spark itself hands the archive to executors) and
    their batches small."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == DEFAULT_ROWS:
        spark.conf.set(BATCH_CONF, TEXT_ROWS)
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # The context's own scratch folder: the driver serves the file from there.
        archive = os.path.join(sc._temp_dir, f"ledgerlight-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for place, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(place, name)
                        out.write(full, os.path.join("ledgerlight", os.path.relpath(full, root)))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
    return df

"""CSV exports.

The reference's ``*_stream`` modules stream a finite query to an HTTP client
as CSV in 5 000-row fetches.  In Spark the same result is a distributed write:
every task of the sort writes its own part file, nothing passes through the
driver.  An export is a folder with

* ``_header.csv``, the line of column names;
* the part files, without a header, in the order of the sort;
* ``_manifest.json``, the files in order with their row counts.

The files in manifest order, one behind the other, are the bytes that Python's
``csv.writer`` with ``\n`` line ends makes of the same rows: an empty field for
NULL, quotes only around fields that need them, quotes doubled, timestamps with
a fraction only where there is one.  Spark's readers skip the two files whose
names begin with an underscore.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.claims import names_in, read_text, write_text
from ledgerlight.operators.paging import sort_columns

HEADER, MANIFEST = "_header.csv", "_manifest.json"
# How an export is read back.
CSV_OPTIONS = {
    "header": "false",
    "multiLine": "true",
    "emptyValue": "",
    "nullValue": "",
    "quote": '"',
    "escape": '"',
    "dateFormat": "yyyy-MM-dd",
    # Python's csv module keeps surrounding blanks; Spark trims them by default.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_filename(base: str, start, end, day_window: tuple[int, int] | None = None) -> str:
    """``<base>_<start>_to_<end>.csv``; a proper ``.csv`` suffix removal
    (N16: the reference strips characters).  Policy exports add the day
    window."""
    stem = base[:-4] if base.lower().endswith(".csv") else base
    if day_window:
        return f"{stem}_d{day_window[0]}-{day_window[1]}_{start}_to_{end}.csv"
    return f"{stem}_{start}_to_{end}.csv"


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans and timestamps as Python's writer prints them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            cols.append(F.when(F.col(f.name), F.lit("True"))
                         .when(~F.col(f.name), F.lit("False")).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_trunc("second", F.col(f.name)).cast(f.dataType) == F.col(f.name)
            cols.append(F.when(whole, F.date_format(f.name, "yyyy-MM-dd HH:mm:ss"))
                         .otherwise(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _field(col: Column) -> Column:
    """One value as the writer prints it."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)


def _line(cols: list[Column]) -> Column:
    """A row; one that would be an empty line is a pair of quotes."""
    if len(cols) > 1:
        return F.concat_ws(",", *[_field(c) for c in cols])
    return F.when(_field(cols[0]) == "", '""').otherwise(_field(cols[0]))


def write_csv(df: DataFrame, path: str, order=None) -> str:
    """Sorted CSV export (range-partitioned sort, one part per task), with
    its header and manifest.  Hidden columns (leading ``_``, e.g. a sort key)
    are not written."""
    spark = df.sparkSession
    out = df if order is None else df.orderBy(*sort_columns(order))
    shown = [c for c in out.columns if not c.startswith("_")]
    ready = csv_ready(out.select(*shown))
    obs = Observation("export")
    lines = ready.select(_line([F.col(c) for c in shown]).alias("value")).observe(obs, F.count(F.lit(1)).alias("rows"))
    lines.write.mode("overwrite").text(path, lineSep="\n")
    names = [n for n in names_in(spark, path) if not n.startswith(("_", "."))]
    # Rows of each part, read back (a field may hold line ends).
    per_file = spark.read.options(**CSV_OPTIONS).schema(T.StructType([T.StructField(c, T.StringType()) for c in shown]))
    rows = {r["name"]: r["n"] for r in per_file.csv(path).select("*", F.col("_metadata.file_name").alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()} if names else {}
    total = sum(rows.values())
    if total and obs.get["rows"] != total:
        raise RuntimeError(f"{path}: {obs.get['rows']} rows written, {total} found")
    header = spark.range(1).select(_line([F.lit(c) for c in shown])).first()[0]
    write_text(spark, f"{path}/{HEADER}", header + "\n")
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({
        "columns": shown, "rows": total,
        "files": [{"name": HEADER, "rows": 0}, *[{"name": n, "rows": rows.get(n, 0)} for n in names]]}))
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``position, name, rows``: the files of an export in the order that makes
    one CSV file of them."""
    files = json.loads(read_text(spark, f"{path}/{MANIFEST}"))["files"]
    return spark.createDataFrame([(i, f["name"], f["rows"]) for i, f in enumerate(files)], "position int, name string, rows long")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with the schema it was written from."""
    shown = [f for f in schema.fields if not f.name.startswith("_")]
    stamps = (T.TimestampType, T.TimestampNTZType)
    as_text = (T.BooleanType, *stamps)
    read_schema = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, as_text) else f.dataType) for f in shown])
    rows = spark.read.options(**CSV_OPTIONS).schema(read_schema).csv(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if isinstance(f.dataType, stamps)
                         else F.col(f.name) for f in shown])

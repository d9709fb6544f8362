"""Loading into warehouse tables.

The reference deletes a date window in 50 000-row batches and inserts in
retried chunks inside one transaction.  On files the same contract is a
windowed replace of month partitions:

1. note which version of each touched month the target shows (a catalog table:
   the folder its partition points to; a storage path: the files it holds);
2. read those months and keep their rows outside the window, with all of the
   target's columns;
3. write them and the new rows, once, to a fresh folder of this run's own, and
   count loaded and rejected rows during that write;
4. take the target's claim (``claims.Claim``).  A month whose version is another
   by now was changed by a second run: its rows are put together again from
   this run's new rows and the month as it is;
5. write a marker with what is to be published and publish.  Months of a catalog
   table are swapped by pointer (``ALTER TABLE ... SET LOCATION``), so a reader
   finds the old or the new month at any time; months of a storage path are
   overwritten in place, and a reader may miss one for a moment;
6. give the claim back.

A lost executor only retries its tasks.  A run that stops before the marker
has not touched the target; one that stops after it is finished first by the
next run on that target, from its complete folder.  Two runs never share a
folder, so neither can destroy what the other writes.  Rows whose date is NULL
or outside the window cannot be placed and go to a ``rejects`` folder instead of
piling up (N18).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import periods as K
from ledgerlight.operators.claims import Claim, age, filesystem, names_in, path_exists, read_text, write_text
from ledgerlight.session import shared_dir
from ledgerlight.sources.schemas import CATALOG_WIDTH, max_length

MONTH_COL = "created_month"
# Column metadata of the date that a table is partitioned by the month of.
SOURCE_KEY = "partition_source"
# Partition of the staging copy that holds the rows a load rejects.
REJECTED = "rejected"
# An unfinished folder that nobody has added to for so long is dropped.
ABANDONED_AFTER = 7 * 24 * 3600.0
_TABLE_NAME = re.compile(r"^[A-Za-z0-9_$]{1,128}$")


def valid_table_name(name: str) -> bool:
    """Letters, digits, ``_`` and ``$``; at most 128 characters."""
    return bool(name) and bool(_TABLE_NAME.match(name))


def valid_name(c: Column) -> Column:
    """B8 for names that stand in a table."""
    return F.coalesce(c.rlike(_TABLE_NAME.pattern), F.lit(False))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Target columns in target order, cast to the target type,
    strings cut to their length, timestamps cut to milliseconds.  Columns the
    target lacks are dropped; target columns the frame lacks become NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            c = c.cast("string")
            n = max_length(f)
            if n:
                c = F.substring(c, 1, n)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_trunc("millisecond", c.cast(f.dataType)).cast(f.dataType)
        else:
            c = c.cast(f.dataType)
        # A catalog's own mark stays with the catalog.
        cols.append(c.alias(f.name, metadata={k: v for k, v in (f.metadata or {}).items() if k != CATALOG_WIDTH}))
    return df.select(*cols)


def cut_counts(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, Observation | None]:
    """``df``, observed for how many values of each length-limited column
    ``conform`` will cut; nothing is read for it beyond the load itself."""
    limited = {f.name: max_length(f) for f in schema.fields
               if isinstance(f.dataType, T.StringType) and max_length(f) and f.name in df.columns}
    if not limited:
        return df, None
    obs = Observation("cuts")
    return df.observe(obs, *[F.count_if(F.length(F.col(c).cast("string")) > n).alias(c) for c, n in limited.items()]), obs


def truncation_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``(column_name, max_length, cut_rows, max_seen)`` for every
    length-limited column present, from one aggregate pass."""
    limited = [(f.name, max_length(f)) for f in schema.fields
               if isinstance(f.dataType, T.StringType) and max_length(f) and f.name in df.columns]
    if not limited:
        return df.sparkSession.createDataFrame(
            [], "column_name string, max_length int, cut_rows bigint, max_seen int")
    aggs = []
    for i, (name, n) in enumerate(limited):
        ln = F.length(F.col(name).cast("string"))
        aggs += [F.count_if(ln > n).alias(f"c{i}"), F.max(ln).alias(f"m{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(n).alias("max_length"),
                              F.col(f"c{i}").cast("bigint").alias("cut_rows"),
                              F.col(f"m{i}").cast("int").alias("max_seen"))
                     for i, (name, n) in enumerate(limited)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def target_schema(spark: SparkSession, target: str) -> T.StructType | None:
    """Reflect an existing target's schema (catalog table name or path);
    None when it does not exist yet.  Only metadata is read."""
    try:
        if "/" in target:
            return spark.read.parquet(target).schema if path_exists(spark, target) else None
        return spark.table(target).schema
    except AnalysisException:
        return None


def column_mismatch(df: DataFrame, schema: T.StructType) -> list[tuple[str, str]]:
    """``[(column, 'extra' | 'missing')]`` -- a schema check, no data read."""
    target = [f.name for f in schema.fields]
    return ([(c, "extra") for c in df.columns if c not in target]
            + [(c, "missing") for c in target if c not in df.columns])


def mismatch_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``(column, issue, lost_values)`` for every column that the frame or
    the target lacks; an extra column's values are lost in a load."""
    found = column_mismatch(df, schema)
    extra = [c for c, issue in found if issue == "extra"]
    lost = df.agg(*[F.count(c).alias(c) for c in extra], F.lit(0).cast("long").alias("_none"))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(issue).alias("issue"),
                     F.col(c if issue == "extra" else "_none").alias("lost_values")) for c, issue in found]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, issue string, lost_values bigint")
    return lost.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def month_source(schema: T.StructType) -> str | None:
    """The date column that a loader-written table's months come from."""
    return next((f.name for f in schema.fields if (f.metadata or {}).get(SOURCE_KEY)), None)


def prunes(df: DataFrame, date_col: str) -> bool:
    """Whether a window on ``date_col`` may be narrowed to its months."""
    return MONTH_COL in df.columns and month_source(df.schema) == date_col


def months_between_bounds(start, end) -> list[str]:
    s, e = K.to_date(start), K.to_date(end)
    out, m = [], dt.date(s.year, s.month, 1)
    while m <= e:
        out.append(m.strftime("%Y-%m"))
        m = K.add_months(m, 1)
    return out


def read_window(spark: SparkSession, path: str, start, end, date_col: str | None = None) -> DataFrame:
    """Read a month-partitioned table (path or catalog name) for a date window on ``date_col``
    (default: the column its months come from).  The month filter prunes
    partitions where the months are that column's; the date filter prunes row
    groups (§4)."""
    table = spark.table(path) if _is_table(path) else spark.read.parquet(path)
    date_col = date_col or month_source(table.schema) or "CreatedDate"
    rows = table.where(K.in_window(date_col, start, end))
    return rows.where(F.col(MONTH_COL).isin(months_between_bounds(start, end))) if prunes(table, date_col) else rows


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = filesystem(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


@dataclass
class LoadResult:
    rows_loaded: int
    rows_rejected: int
    months_rewritten: list[str]
    months_emptied: list[str]
    rejects_path: str | None
    # Months that another run changed meanwhile, put together again.
    months_restaged: list[str] = field(default_factory=list)


def _is_table(target: str) -> bool:
    """A catalog table name (``db.table``) rather than a storage path."""
    return "/" not in target and ":" not in target


def read_target(spark: SparkSession, target: str) -> DataFrame | None:
    """The current target rows; None when it does not exist or holds no
    data file (every month emptied by an earlier reload)."""
    if _is_table(target):
        return spark.table(target) if spark.catalog.tableExists(target) else None
    if not path_exists(spark, target):
        return None
    try:
        return spark.read.parquet(target)
    except AnalysisException:
        return None


def table_location(spark: SparkSession, table: str, month: str | None = None) -> str:
    """Where the catalog says a table (or one of its months) lies."""
    part = f" PARTITION ({MONTH_COL} = '{month}')" if month else ""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}{part}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"].rstrip("/")


def _table_months(spark: SparkSession, table: str) -> set[str]:
    return {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def all_months(spark: SparkSession, target: str) -> list[str]:
    """Every month that a target holds."""
    if _is_table(target):
        return sorted(_table_months(spark, target)) if spark.catalog.tableExists(target) else []
    return [n.partition("=")[2] for n in names_in(spark, target) if n.startswith(f"{MONTH_COL}=")]


def month_versions(spark: SparkSession, target: str, months: list[str]) -> dict[str, str]:
    """What tells one state of a month from the next, for the months that are there."""
    if _is_table(target):
        if not spark.catalog.tableExists(target):
            return {}
        return {m: table_location(spark, target, m) for m in sorted(_table_months(spark, target) & set(months))}
    found = {m: names_in(spark, f"{target}/{MONTH_COL}={m}") for m in months}
    return {m: "/".join(names) for m, names in found.items() if names}


def _publish(spark: SparkSession, target: str, folders: dict[str, str], emptied: list[str], location: str | None,
             check=lambda: None) -> None:
    """Let the target show the months in ``folders`` (month -> folder that holds
    its partition) and none of the emptied ones.  Doing it again has the same
    result.  ``check`` stops a run that has lost its claim."""
    if _is_table(target):
        if not spark.catalog.tableExists(target):
            return
        there = _table_months(spark, target)
        for m, folder in folders.items():
            check()
            where = f"{folder}/{MONTH_COL}={m}"
            _point(spark, target, m, where, m in there)
        for m in emptied:
            check()
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({MONTH_COL} = '{m}')")
        return
    copied: dict[str, list[str]] = {}
    for m, folder in folders.items():
        check()
        if not _move(spark, f"{folder}/{MONTH_COL}={m}", target, f"{MONTH_COL}={m}"):
            copied.setdefault(folder, []).append(m)
    for folder, months in sorted(copied.items()):
        check()
        staged = spark.read.parquet(folder).where(F.col(MONTH_COL).isin(months))
        (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy(MONTH_COL).parquet(target))
    for m in emptied:
        check()
        _delete(spark, f"{target}/{MONTH_COL}={m}")


def _move(spark: SparkSession, staged: str, target: str, name: str) -> bool:
    """Put a staged month where the target shows it; False if its rows must be
    copied, as between two file systems.  A month that is no longer staged has
    been moved before."""
    (from_fs, src, _), (fs, root, _), (_, dst, _) = (filesystem(spark, p) for p in (staged, target, f"{target}/{name}"))
    if not from_fs.exists(src):
        return True
    if from_fs.getUri().toString() != fs.getUri().toString():
        return False
    fs.mkdirs(root)
    if fs.exists(dst):
        fs.delete(dst, True)
    return bool(fs.rename(src, dst))


def _point(spark: SparkSession, table: str, month: str, folder: str, there: bool) -> None:
    """One pointer: the month is the old folder before and the new one after."""
    if there:
        spark.sql(f"ALTER TABLE {table} PARTITION ({MONTH_COL} = '{month}') SET LOCATION '{folder}'")
    else:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({MONTH_COL} = '{month}') LOCATION '{folder}'")


def _staging_root(work: str, target: str) -> str:
    return f"{work}/_staging/{hashlib.sha256(target.encode()).hexdigest()[:16]}"


def _claim(spark: SparkSession, target: str, work: str) -> Claim:
    return Claim(spark, f"{_staging_root(work, target)}/_claims")


def recover(spark: SparkSession, target: str, work: str, check=lambda: None) -> int:
    """Publish complete folders that stopped runs on the target left behind, and
    drop incomplete ones that nobody has added to for a week.  Returns how many
    were published.  Runs under the target's claim: a marker that is there then
    belongs to a run that has stopped."""
    root, done = _staging_root(work, target), 0
    runs = [n for n in names_in(spark, root) if n != "_claims"]
    for folder in sorted((f"{root}/{n}" for n in runs), key=lambda f: -age(spark, f)):
        if path_exists(spark, f"{folder}/marker.json"):
            todo = json.loads(read_text(spark, f"{folder}/marker.json"))
            _publish(spark, target, todo["folders"], todo["emptied"], todo["location"], check)
            done += 1
            _delete(spark, folder)
        elif age(spark, folder) > ABANDONED_AFTER:
            _delete(spark, folder)
    return done


def _shaped(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    """``rows`` in the columns of an existing target, cut to its widths."""
    if existing is None:
        return rows
    have, cols = set(rows.columns), []
    for f in existing.schema.fields:
        if f.name != MONTH_COL:
            c = F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
            n = max_length(f) if isinstance(f.dataType, T.StringType) else None
            cols.append((F.substring(c, 1, n) if n else c).alias(
                f.name, metadata={k: v for k, v in (f.metadata or {}).items() if k != CATALOG_WIDTH}))
    return rows.select(*cols)


def _write_months(rows: DataFrame, date_col: str, folder: str, obs: Observation | None = None, metrics=()) -> set[str]:
    """Write ``rows`` by month; the months that have rows."""
    marked = F.col(date_col).alias(date_col, metadata={**(rows.schema[date_col].metadata or {}), SOURCE_KEY: True})
    rows = rows.select(*[marked if c == date_col else F.col(c) for c in rows.columns])
    # REBALANCE by month: AQE packs each month into files of the advisory
    # size and splits a hot month over several tasks, instead of every task
    # writing one small file per month it happens to hold.  The counts are
    # taken behind it, in the tasks that write.
    rows = rows.hint("rebalance", MONTH_COL)
    if obs is not None:
        rows = rows.observe(obs, *metrics)
    rows.write.mode("overwrite").partitionBy(MONTH_COL).parquet(folder)
    return {n.partition("=")[2] for n in names_in(rows.sparkSession, folder) if n.startswith(f"{MONTH_COL}=")}


def windowed_replace(spark: SparkSession, new_rows: DataFrame, target: str, start, end,
                     date_col: str = "CreatedDate", work_dir: str | None = None,
                     location: str | None = None) -> LoadResult:
    """B1 (+B9, B12): replace every target row whose ``date(date_col)`` lies
    in ``[start, end]`` by ``new_rows`` (all countries).

    ``target`` is a storage path or a catalog table name; a table that does
    not exist yet is created partitioned by month (at ``location`` if given).
    An existing target keeps its columns: those that ``new_rows`` lack are NULL
    in the new rows, others of ``new_rows`` are left out, and strings are cut to
    declared widths.  Loads of one target may run at the same time: they
    publish one after the other, and each keeps what the other has loaded."""
    s, e = K.to_date(start), K.to_date(end)
    if e < s:
        raise ValueError("end_date before start_date")
    if _is_table(target) and not re.match(r"^[A-Za-z0-9_$]{1,128}(\.[A-Za-z0-9_$]{1,128})?$", target):
        raise ValueError(f"invalid table name {target!r}")
    work = (work_dir or shared_dir(spark)).rstrip("/")
    with _claim(spark, target, work) as claim:
        recover(spark, target, work, claim.check)
    token = uuid.uuid4().hex
    staging = f"{_staging_root(work, target)}/{token}"
    months = months_between_bounds(s, e)
    in_win = F.coalesce(F.to_date(F.col(date_col)).between(F.lit(s), F.lit(e)), F.lit(False))

    seen = month_versions(spark, target, months)
    existing = read_target(spark, target)
    if existing is not None:
        source = month_source(existing.schema)
        if source not in (None, date_col):
            raise ValueError(f"{target} is partitioned by the month of {source}, not of {date_col}")
    # A row outside the window would land in a month partition this run does
    # not own and overwrite it: such rows, and rows without a date, are rejected.
    staged = _shaped(new_rows, existing).withColumn(
        MONTH_COL, F.when(in_win, F.date_format(date_col, "yyyy-MM")).otherwise(F.lit(REJECTED)))
    if existing is None and _is_table(target):
        made = spark.createDataFrame([], staged.schema)
        marked = F.col(date_col).alias(date_col, metadata={SOURCE_KEY: True})
        writer = made.select(*[marked if c == date_col else F.col(c) for c in made.columns]).write.format("parquet").partitionBy(MONTH_COL)
        (writer.option("path", location) if location else writer).mode("ignore").saveAsTable(target)
    # A table's months stay where they are written; a path's are moved.
    home = f"{table_location(spark, target)}/_loads/{token}" if _is_table(target) else staging
    if existing is not None:
        staged = staged.unionByName(existing.where(F.col(MONTH_COL).isin(months) & ~in_win))
    # Kept rows lie outside the window, so the rows inside it are the loaded ones.
    placed = F.col(MONTH_COL) != REJECTED
    obs = Observation("load")
    found = _write_months(staged, date_col, f"{home}/rows", obs,
                          [F.count_if(placed & in_win).alias("loaded"), F.count_if(~placed).alias("rejected")])
    counts = obs.get if found else {"loaded": 0, "rejected": 0}
    rejects = f"{work}/_rejects/{token}" if counts["rejected"] else None
    if rejects:
        spark.read.parquet(f"{home}/rows").where(~placed).drop(MONTH_COL).write.mode("overwrite").parquet(rejects)

    with _claim(spark, target, work) as claim:
        recover(spark, target, work, claim.check)
        now = month_versions(spark, target, months)
        moved = [m for m in months if now.get(m) != seen.get(m)]
        folders = {m: f"{home}/rows" for m in months if m in found}
        if moved:
            folders |= dict.fromkeys(_restage(spark, target, f"{home}/rows", f"{home}/again", moved, bool(found), in_win, date_col), f"{home}/again")
            again = set(names_in(spark, f"{home}/again"))
            folders = {m: f for m, f in folders.items() if m not in moved or f"{MONTH_COL}={m}" in again}
        emptied = [m for m in months if m not in folders]
        gone = [m for m in emptied if m in now]
        write_text(spark, f"{staging}/marker.json", json.dumps({"folders": folders, "emptied": gone, "location": location}))
        claim.check()
        _publish(spark, target, folders, gone, location, claim.check)
        _delete(spark, staging)
    return LoadResult(counts["loaded"], counts["rejected"], sorted(folders), emptied, rejects, moved)


def _restage(spark: SparkSession, target: str, written: str, folder: str, months: list[str], any_rows: bool,
             in_win, date_col: str) -> set[str]:
    """Months that changed since they were read: this run's new rows with the
    rows outside the window as they are now."""
    existing = read_target(spark, target)
    parts = []
    if any_rows:
        fresh = spark.read.parquet(written).where(F.col(MONTH_COL).isin(months) & in_win)
        parts.append(_shaped(fresh, existing).withColumn(MONTH_COL, F.date_format(date_col, "yyyy-MM")))
    if existing is not None:
        parts.append(existing.where(F.col(MONTH_COL).isin(months) & ~in_win))
    if not parts:
        return set()
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _write_months(rows, date_col, folder)


def drop_unused_months(spark: SparkSession, table: str, older_than: float = ABANDONED_AFTER) -> list[str]:
    """Delete month folders of a catalog table that no partition points to and
    nobody has touched for ``older_than`` seconds (readers that began before a
    swap have ended by then).  Returns them."""
    home = f"{table_location(spark, table)}/_loads"
    used = {table_location(spark, table, m) for m in _table_months(spark, table)}
    out = []
    for run in names_in(spark, home):
        for part in ("rows", "again"):
            for name in names_in(spark, f"{home}/{run}/{part}"):
                folder = f"{home}/{run}/{part}/{name}"
                if name.startswith(f"{MONTH_COL}=") and folder not in used and age(spark, folder) > older_than:
                    _delete(spark, folder)
                    out.append(folder)
    return out

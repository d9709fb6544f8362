"""ETL jobs (M8): regional extraction -> fan-in -> clean -> conform -> reload.

One lazy plan per fact: the five regional fact builders are unioned by name,
tagged, cleaned and conformed, and a single windowed replace writes it.  The
five scans run as parallel stages of one job (the reference runs them one
after another).
"""

from __future__ import annotations

import datetime as dt
import logging
from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight import config
from ledgerlight.config import Domain
from ledgerlight.functions import periods as K
from ledgerlight.operators import load
from ledgerlight.plans import facts
from ledgerlight.sources import schemas
from ledgerlight.sources.registry import fan_in

logger = logging.getLogger(__name__)

Builder = Callable[..., DataFrame]

def _crm_builder(src, start, end, domain: Domain, as_of=None) -> DataFrame:
    """M7 as a loader: the CRM extraction's window is on the quote date with
    an exclusive end, so the inclusive ETL window ends the next day."""
    end_exclusive = K.to_date(end) + dt.timedelta(days=1)
    return facts.crm_fact(src, start, end_exclusive, K.to_date(as_of), domain)


# kind -> (builder for AU/NZ, builder for UK/DE/AT, target schema, table name)
JOBS: dict[str, tuple[Builder, Builder, T.StructType, str]] = {
    "quote": (facts.quote_fact_a, facts.quote_fact_b, schemas.QUOTE, "Quote"),
    "sales": (facts.sales_fact_a, facts.sales_fact_b, schemas.SALES, "Sales"),
    "free_policies": (facts.free_fact_a, facts.free_fact_b, schemas.FREE_POLICY, "FreePolicySales"),
    # One CRM query serves every region (no regional variant).
    "crm": (_crm_builder, _crm_builder, schemas.CRM, "CRM"),
}
# The date column a job's window (and reload) is defined on.
WINDOW_COLUMN = {"quote": "CreatedDate", "sales": "CreatedDate", "free_policies": "CreatedDate",
                 "crm": "QuoteStartDate"}
# Date columns cleaned per job.
CLEAN_DATES = {
    "quote": ["CreatedDate", "QuoteStartDate", "QuoteExpiryDate", "PolicyStartDate",
              "PolicyEndDate", "PetBirthDate", "ETLDateUploaded"],
    "sales": ["CreatedDate", "ActualStartDate", "ETLDateUploaded", "QuoteCreatedDate"],
    "free_policies": ["CreatedDate", "ETLDateUploaded"],
    "crm": ["QuoteCreatedDate", "QuoteStartDate", "ETLDateUploaded"],
}
# Regions whose brand is forced to the constant (A3).
BRAND_OVERRIDE = ("at", "de")


def extract(kind: str, src: Mapping[str, DataFrame], code: str, name: str, family: str,
            start, end, domain: Domain, as_of=None) -> DataFrame:
    """A1/A3: one region's fact for the window, tagged with its country."""
    a, b, _, _ = JOBS[kind]
    builder = a if family == "au_nz" else b
    fact = (builder(src, start, end, domain, as_of=as_of) if kind == "crm"
            else builder(src, start, end, domain))
    df = fact.withColumns(
        {"CountryCode": F.lit(code), "CountryName": F.lit(name)})
    if code.lower() in BRAND_OVERRIDE:
        df = df.withColumn("Brand", F.lit(domain.brand_constant))
    return df


def clean_dates(df: DataFrame, cols) -> DataFrame:
    """Coerce listed date columns; before 1753-01-01 or unparseable -> NULL.
    Timestamp columns keep their type; text columns are parsed."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    repl = {}
    for c in cols:
        if c not in types:
            continue
        if isinstance(types[c], (T.TimestampType, T.TimestampNTZType, T.DateType)):
            floor = K.ntz_literal(K.MIN_STORE_DATE).cast(types[c])
            repl[c] = F.when(F.col(c) >= floor, F.col(c))
        else:
            repl[c] = K.clean_date(c)
    return df.withColumns(repl) if repl else df


def transform(df: DataFrame, kind: str, as_of: dt.date) -> DataFrame:
    """A4 + K11: load-date stamp, then date cleanup."""
    stamped = df.withColumn("ETLDateUploaded", K.ntz_literal(K.to_date(as_of)))
    return clean_dates(stamped, CLEAN_DATES[kind])


def etl_frame(kind: str, sources: Mapping[str, Mapping[str, DataFrame]], start, end, as_of,
              domain: Domain, regions=config.REGIONS, target: T.StructType | None = None) -> DataFrame:
    """A2/I3 + transform + B3 conform: the frame a reload writes, in the
    columns and widths of an existing target if given."""
    parts = [extract(kind, sources[code], code, name, family, start, end, domain, as_of)
             for code, name, family in regions]
    _, _, schema, _ = JOBS[kind]
    return load.conform(transform(fan_in(parts), kind, as_of), target or schema)


def run_etl(spark: SparkSession, kind: str, sources, start, end, as_of, target: str,
            domain: Domain, location: str | None = None) -> load.LoadResult:
    """M8: build and reload one fact for ``[start, end]`` (a catalog table that
    does not exist yet is made at ``location``)."""
    table = JOBS[kind][3]
    if not load.valid_table_name(table):
        raise ValueError(f"invalid table name {table!r}")
    default = JOBS[kind][2]
    found = load.target_schema(spark, target)
    # The reflected target decides on columns and widths.
    schema = T.StructType([f for f in (found or default).fields if f.name != load.MONTH_COL])
    frame = etl_frame(kind, sources, start, end, as_of, domain, target=default)
    for column, issue in load.column_mismatch(frame, schema):  # B5
        logger.warning("%s: column %s is %s in the target", table, column, issue)
    frame, cuts = load.cut_counts(frame, schema)
    result = load.windowed_replace(spark, load.conform(frame, schema), target, start, end,
                                   date_col=WINDOW_COLUMN[kind], location=location)
    for column, n in (cuts.get if cuts and result.rows_loaded + result.rows_rejected else {}).items():
        if n:
            logger.warning("%s: %d values of %s were cut to the target's width", table, n, column)
    return result

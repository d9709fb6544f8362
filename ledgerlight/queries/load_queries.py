"""Driver queries for loading, ETL and CSV export."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight import config
from ledgerlight.functions import periods as K
from ledgerlight.operators import load, paging
from ledgerlight.plans import etl, facts
from ledgerlight.plans import reports as R
from ledgerlight.registry import REGISTRY, register
from ledgerlight.session import shared_dir
from ledgerlight.sources import schemas
from ledgerlight.sources.adapters import RegionalSources, RegionalTables
from ledgerlight.sources.production import VIEWS, SourceViews
from ledgerlight.sources.registry import source_registry
from ledgerlight.sources.snapshots import Snapshot
from ledgerlight.streaming import csv_export

WW = config.WIDE_WINDOW
EXTRACTED_AT = dt.datetime(2001, 7, 10, 12, 0, 0)


def _fixture_regions(src):
    """Five regional source databases carved out of the fixture folder (one
    per client region; dimensions shared).  All of them share one reading of the
    large tables."""
    keys = {code: config.FIXTURE_REGION_KEYS[code] for code, _, _ in config.REGIONS}
    tables = RegionalTables(src.spark, src.sf_dir, keys.values())
    return {code: RegionalSources(src.spark, src.sf_dir, key, tables) for code, key in keys.items()}


def _etl_oracle(kind: str) -> str:
    """DuckDB text of an ETL frame: the regional fact oracles, tagged,
    brand-overridden for AT/DE, date-cleaned and conformed."""
    schema = etl.JOBS[kind][2]
    names = {"quote": ("fact_quote_a", "fact_quote_b"), "sales": ("fact_sales_a", "fact_sales_b"),
             "free_policies": ("fact_free_a", "fact_free_b"), "crm": ("fact_crm", "fact_crm")}[kind]
    fact_cols = [f.name for f in schema.fields
                 if f.name not in ("CountryCode", "CountryName", "ETLDateUploaded")]
    parts = []
    for code, name, family in config.REGIONS:
        entry = REGISTRY[names[0] if family == "au_nz" else names[1]]
        body = entry.oracle(config.FIXTURE_REGION_KEYS[code])
        brand = config.FIXTURE_DOMAIN.brand_constant
        cols = ", ".join(f"'{brand}' AS Brand" if c == "Brand" and code.lower() in ("at", "de") else c
                         for c in fact_cols)
        parts.append(f"SELECT {cols}, '{code}' AS CountryCode, '{name}' AS CountryName "
                     f"FROM ({body}) t_{code}")
    clean = set(etl.CLEAN_DATES[kind])
    out = []
    for f in schema.fields:
        n, c = f.name, f.name
        if n == "ETLDateUploaded":
            out.append("TIMESTAMP '2001-07-10 00:00:00' AS ETLDateUploaded")
            continue
        if n in clean:
            c = f"CASE WHEN {n} >= TIMESTAMP '1753-01-01 00:00:00' THEN {n} END"
        n_max = schemas.max_length(f)
        if n_max:
            c = f"substring({c}, 1, {n_max})"
        if n in TEXT_COMPARED:
            c = f"CAST(CAST({c} AS INTEGER) AS VARCHAR)"
        out.append(f"{c} AS {n}")
    return f"SELECT {', '.join(out)}\nFROM ({' UNION ALL '.join(parts)}) u"


# Nullable INT columns compared as text by the gate (engine-neutral pandas dtype).
TEXT_COMPARED = {"PetBreedId"}


def _free_etl_oracle() -> str:
    return _etl_oracle("free_policies")


@register("etl_job", (), ids="M8 A2 A3 A4 I3 K11 B3 B4 B6 C17", oracle_fn=_free_etl_oracle)
def etl_job(src):
    """Free-policy ETL frame: five regions, tagged, cleaned, conformed."""
    return etl.etl_frame("free_policies", _fixture_regions(src), *config.FULL_WINDOW, config.AS_OF, config.FIXTURE_DOMAIN)


@register("etl_quote_frame", (), ids="M8 (quote) A2 A3 I3 K11 B3", oracle_fn=lambda: _etl_oracle("quote"))
def etl_quote_frame(src):
    return etl.etl_frame("quote", _fixture_regions(src), *config.FULL_WINDOW, config.AS_OF, config.FIXTURE_DOMAIN)


@register("etl_sales_frame", (), ids="M8 (sales) A2 A3 I3 K11 B3", oracle_fn=lambda: _etl_oracle("sales"))
def etl_sales_frame(src):
    return etl.etl_frame("sales", _fixture_regions(src), *config.FULL_WINDOW, config.AS_OF, config.FIXTURE_DOMAIN)


@register("etl_crm_frame", (), ids="M7 M8 (CRM loader) A2 A3 I3 K11 B3", oracle_fn=lambda: _etl_oracle("crm"))
def etl_crm_frame(src):
    """The CRM loader's frame: the customer-360 fact per regional source,
    tagged, cleaned and conformed (PetBreedId compared as text)."""
    frame = etl.etl_frame("crm", _fixture_regions(src), *config.FULL_WINDOW, config.AS_OF, config.FIXTURE_DOMAIN)
    return frame.withColumn("PetBreedId", F.col("PetBreedId").cast("string"))


def _etl_reload_oracle() -> str:
    frame = _etl_oracle("sales")
    return f"""
SELECT *, strftime(CreatedDate, '%Y-%m') AS created_month FROM ({frame}) f
"""


@register("etl_reload_sales", (), ids="M8 B1 B12 (full ETL run, then a window reload)",
          oracle_fn=_etl_reload_oracle)
def etl_reload_sales(src):
    """``run_etl`` end to end: load the whole range, then reload the wide
    window from the same sources; the table must equal one clean load."""
    spark = src.spark
    target = f"{shared_dir(spark)}/ledgerlight-etl-{uuid.uuid4().hex}/Sales"
    regions = _fixture_regions(src)
    etl.run_etl(spark, "sales", regions, *config.FULL_WINDOW, config.AS_OF, target, config.FIXTURE_DOMAIN)
    etl.run_etl(spark, "sales", regions, *WW, config.AS_OF, target, config.FIXTURE_DOMAIN)
    return spark.read.parquet(target)


SALES_COLS = ["CountryCode", "CountryName", "Brand", "PolicyNumber", "CreatedDate", "ActualStartDate",
              "ProductName", "PetType", "ClientName", "PetName", "SaleMethod", "QuoteNumber",
              "QuoteCreatedDate"]


@register("windowed_replace", ("sales_wh",), ids="B1", oracle=f"""
SELECT {', '.join(SALES_COLS)}, strftime(CreatedDate, '%Y-%m') AS created_month
FROM sales_wh
WHERE NOT (CAST(CreatedDate AS DATE) BETWEEN DATE '2001-01-15' AND DATE '2001-06-20')
UNION ALL
SELECT {', '.join('upper(SaleMethod) AS SaleMethod' if c == 'SaleMethod' else c for c in SALES_COLS)},
       strftime(CreatedDate, '%Y-%m') AS created_month
FROM sales_wh
WHERE CAST(CreatedDate AS DATE) BETWEEN DATE '2001-01-15' AND DATE '2001-06-20'
  AND month(CreatedDate) <> 2
""")
def windowed_replace(src):
    """Load the whole sales table, then reload the wide window with changed
    rows and no February rows (February must end up empty)."""
    spark = src.spark
    target = f"{shared_dir(spark)}/ledgerlight-wr-{uuid.uuid4().hex}/Sales"
    sales = src["sales_wh"].select(*SALES_COLS)
    load.windowed_replace(spark, sales, target, *config.FULL_WINDOW)
    reload = (sales.where(K.in_window("CreatedDate", *WW) & (F.month("CreatedDate") != 2))
                   .withColumn("SaleMethod", F.upper("SaleMethod")))
    load.windowed_replace(spark, reload, target, *WW)
    return spark.read.parquet(target)


# A target table with declared widths.
QUOTE_TARGET = schemas.with_widths(schemas.QUOTE, {
    "Brand": 50, "QuoteNumber": 50, "FullName": 12, "Email": 100, "Suburb": 100, "CountryCode": 10,
    "CountryName": 50, "BreedName": 100})


def _trunc_oracle() -> str:
    limited = [(f.name, schemas.max_length(f)) for f in QUOTE_TARGET.fields
               if schemas.max_length(f)]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, {m} AS max_length, "
        f"CAST(count_if(length({n}) > {m}) AS BIGINT) AS cut_rows, "
        f"CAST(max(length({n})) AS INTEGER) AS max_seen FROM quote_wh"
        for n, m in limited if n not in ("ETLDateUploaded",))


@register("truncation_report", ("quote_wh",), ids="B3 B4", oracle_fn=_trunc_oracle)
def truncation_report(src):
    return load.truncation_report(src["quote_wh"], QUOTE_TARGET)


@register("conform_truncate", ("quote_wh",), ids="B3 B4 B6", oracle="""
SELECT Brand, PolicyCreatedDate, QuoteNumber, CreatedDate, QuoteStartDate, QuoteExpiryDate,
       QuoteReceivedMethod, PolicyNumber, PolicyStartDate, PolicyEndDate,
       substring(FullName, 1, 12) AS FullName, Email, Address, Suburb, PostCode, ContactNo,
       PetName, PetType, PetBirthDate, BreedName, substring(CountryCode, 1, 10) AS CountryCode, CountryName,
       CAST(NULL AS TIMESTAMP) AS ETLDateUploaded
FROM quote_wh
""")
def conform_truncate(src):
    return load.conform(src["quote_wh"], QUOTE_TARGET)


CSV_COLS = R.QUOTE_LISTING_COLUMNS


@register("csv_roundtrip", ("quote_wh",), ids="B10 M10-CSV", oracle=f"""
SELECT CountryName, CountryCode, Brand, QuoteNumber,
       CASE WHEN coalesce(QuoteExpiryDate, QuoteStartDate) IS NULL THEN NULL
            WHEN DATE '2001-07-10' > QuoteExpiryDate THEN 'Lapsed' ELSE 'Live' END AS QuoteStatus,
       CASE WHEN PolicyNumber IS NULL OR PolicyNumber ILIKE '%none%' THEN 'No' ELSE 'Yes' END AS ConvertedQuote,
       CASE WHEN (nullif(trim(FullName), '') IS NULL OR nullif(trim(Email), '') IS NULL
                  OR nullif(trim(Address), '') IS NULL OR nullif(trim(PostCode), '') IS NULL
                  OR nullif(trim(ContactNo), '') IS NULL OR nullif(trim(PetType), '') IS NULL
                  OR nullif(trim(PetName), '') IS NULL) THEN 'No' ELSE 'Yes' END AS QuoteDetailsCompleted,
       CreatedDate, QuoteStartDate, QuoteExpiryDate, QuoteReceivedMethod, FullName, Email, ContactNo,
       PetName, PetType, BreedName, PetBirthDate, PolicyNumber, PolicyCreatedDate
FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
""")
def csv_roundtrip(src):
    """Quote CSV export (M10 download form): write, then read back."""
    spark = src.spark
    rows, order = R.quote_export_rows(src["quote_wh"], *WW, config.AS_OF, shape="quote_csv")
    return _roundtrip(spark, rows, order, csv_export.export_filename("quotes.csv", *WW))


def _roundtrip(spark, rows, order, name):
    path = f"{shared_dir(spark)}/ledgerlight-csv-{uuid.uuid4().hex}/{name}"
    csv_export.write_csv(rows, path, order=order)
    return csv_export.read_csv(spark, path, rows.schema)


MW = config.MONTH_WINDOW


@register("csv_sales_export", ("sales_wh",), ids="M20-CSV B10 N15", oracle="""
SELECT CountryName, CountryCode, Brand, QuoteNumber, QuoteCreatedDate, PolicyNumber,
       CreatedDate AS PolicyCreatedDate, ActualStartDate, ProductName, PetType, ClientName, PetName
FROM sales_wh
WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
""")
def csv_sales_export(src):
    rows, order = R.sales_export_rows(src["sales_wh"], *MW)
    return _roundtrip(src.spark, rows, order, csv_export.export_filename("sales.csv", *MW))


@register("csv_free_export", ("free_wh",), ids="M19-CSV B10 C22", oracle="""
SELECT CountryCode, CountryName, QuoteNumber, PolicyNumber, CreatedDate, SubAgentName, AgentCategoryId,
       CASE AgentCategoryId WHEN 8 THEN 'Breeder' WHEN 7 THEN 'Pet Business' WHEN 6 THEN 'Charities'
            WHEN 5 THEN 'Vet' END AS AgentCategory,
       PetType, ProductName, StateName, SaleMethod, PolicyStatusName, Brand
FROM free_wh
WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
""")
def csv_free_export(src):
    rows, order = R.free_export_rows(src["free_wh"], *MW)
    return _roundtrip(src.spark, rows, order, csv_export.export_filename("free_policies.csv", *MW))


@register("csv_manifest", ("sales_wh",), ids="B10 B11 M20-CSV", oracle="""
SELECT count(*) AS rows_in_parts, 'CountryName' AS first_column
FROM sales_wh
WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
""")
def csv_manifest(src):
    """Rows that the manifest of a sales export counts in its parts, and the
    first name of its header."""
    spark = src.spark
    rows, order = R.sales_export_rows(src["sales_wh"], *MW)
    path = f"{shared_dir(spark)}/ledgerlight-csv-{uuid.uuid4().hex}/{csv_export.export_filename('sales.csv', *MW)}"
    csv_export.write_csv(rows, path, order=order)
    head = F.lit(csv_export.read_text(spark, f"{path}/{csv_export.HEADER}").split(",")[0])
    return csv_export.manifest(spark, path).agg(F.sum("rows").alias("rows_in_parts"), F.max(head).alias("first_column"))


@register("csv_policy_export", ("crm_wh",), ids="M23-CSV B10 B11 C20 C26 C27 K-clamp", oracle="""
SELECT TIMESTAMP '2001-07-10 12:00:00' AS DateExtracted, Brand,
       coalesce(nullif(Country, ''), CountryCode) AS Country,
       nullif(BusinessName, '') AS BusinessName, nullif(BusinessType, '') AS BusinessType,
       CustomerStatus, FreePolicy, QuoteStatus, QuoteNumber, PolicyNumber, QuoteReceivedMethod,
       QuoteCreatedDate, QuoteStartDate, QuoteEndDate, OriginalPolicyStartDate, PolicyEndDate,
       FirstName, LastName, Email, ContactNo, EmailConcent, PetName, PetType, PetBirthDate,
       PetBreedId, BreedName, CountryCode,
       CASE WHEN PolicyNumber IS NOT NULL THEN 'True' ELSE 'False' END AS Converted
FROM crm_wh
WHERE QuoteCreatedDate >= DATE '2001-01-15' AND QuoteCreatedDate < DATE '2001-06-21'
  AND day(QuoteCreatedDate) >= least(15, day(last_day(QuoteCreatedDate)))
  AND day(QuoteCreatedDate) <= least(20, day(last_day(QuoteCreatedDate)))
""")
def csv_policy_export(src):
    """Policy CSV: CSV cannot tell an empty text from a missing one, so the
    blank business columns read back as NULL (as in the reference's files)."""
    rows, order = R.policy_export_rows(src["crm_wh"], *WW, EXTRACTED_AT)
    s, e = WW
    name = csv_export.export_filename("policy_status.csv", s, e, (s.day, e.day))
    return _roundtrip(src.spark, rows, order, name)


@register("warehouse_sales_by_bucket", (), ids="M8 M17 B1 (report on the loaded, month-pruned table)",
          oracle_fn=lambda: f"""
WITH s AS ({_etl_oracle("sales")})
SELECT CASE WHEN lower(coalesce(PetType, '')) LIKE '%cat%' THEN 'Cat'
            WHEN lower(coalesce(PetType, '')) LIKE '%dog%' THEN 'Dog'
            WHEN lower(coalesce(PetType, '')) LIKE '%horse%' THEN 'Horse'
            WHEN lower(coalesce(PetType, '')) LIKE '%exotic%' THEN 'Exotic'
            WHEN lower(coalesce(PetType, '')) LIKE '%bb_com%' THEN 'BB'
            ELSE 'Others' END AS name,
       count(PolicyNumber) AS value
FROM s
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
  AND upper(CountryCode) IN ('NZ', 'AU')
GROUP BY 1
""")
def warehouse_sales_by_bucket(src):
    """Production path: ETL the sales fact into a month-partitioned
    warehouse, then run the pet-type report on a pruned read."""
    from ledgerlight.plans.warehouse import Warehouse
    spark = src.spark
    wh = Warehouse(spark, f"{shared_dir(spark)}/ledgerlight-wh-{uuid.uuid4().hex}")
    wh.load("sales", _fixture_regions(src), *config.FULL_WINDOW, config.AS_OF, config.FIXTURE_DOMAIN)
    return R.count_by_pet_bucket(wh.read("Sales", *WW), "PolicyNumber", *WW, countries="nz, AU")


@register("reload_keeps_columns", ("sales_wh",), ids="B1", oracle=f"""
SELECT PolicyNumber, CreatedDate,
       CASE WHEN CAST(CreatedDate AS DATE) BETWEEN DATE '2001-01-15' AND DATE '2001-06-20' THEN NULL
            ELSE PetType END AS PetType
FROM sales_wh
""")
def reload_keeps_columns(src):
    """A reload whose rows lack a column of the target: rows outside the window
    keep its values, also in the months that the window cuts."""
    spark = src.spark
    target = f"{shared_dir(spark)}/ledgerlight-keep-{uuid.uuid4().hex}/Sales"
    sales = src["sales_wh"].select("PolicyNumber", "CreatedDate", "PetType")
    load.windowed_replace(spark, sales, target, *config.FULL_WINDOW)
    load.windowed_replace(spark, sales.drop("PetType").where(K.in_window("CreatedDate", *WW)), target, *WW)
    return spark.read.parquet(target).drop(load.MONTH_COL)


@register("load_summary", ("sales_wh",), ids="B9 B12 N18", oracle="""
SELECT CAST(count_if(QuoteCreatedDate IS NOT NULL) AS BIGINT) AS rows_loaded,
       CAST(count_if(QuoteCreatedDate IS NULL) AS BIGINT) AS rows_rejected
FROM (SELECT CASE WHEN QuoteNumber LIKE '%7' THEN NULL ELSE QuoteCreatedDate END AS QuoteCreatedDate FROM sales_wh) s
""")
def load_summary(src):
    """Rows without a date are rejected and counted."""
    spark = src.spark
    target = f"{shared_dir(spark)}/ledgerlight-sum-{uuid.uuid4().hex}/Sales"
    rows = src["sales_wh"].withColumn("QuoteCreatedDate", F.when(~F.col("QuoteNumber").like("%7"), F.col("QuoteCreatedDate")))
    got = load.windowed_replace(spark, rows, target, *config.FULL_WINDOW, date_col="QuoteCreatedDate")
    return spark.createDataFrame([(got.rows_loaded, got.rows_rejected)], "rows_loaded long, rows_rejected long")


@register("crm_window_read", ("crm_wh",), ids="B1", oracle="""
SELECT QuoteNumber, QuoteCreatedDate, QuoteStartDate FROM crm_wh
WHERE QuoteCreatedDate >= DATE '2001-01-15' AND QuoteCreatedDate < DATE '2001-06-21'
""")
def crm_window_read(src):
    """A window on another date than the one the table's months come from."""
    spark = src.spark
    target = f"{shared_dir(spark)}/ledgerlight-crm-{uuid.uuid4().hex}/CRM"
    rows = src["crm_wh"].select("QuoteNumber", "QuoteCreatedDate", "QuoteStartDate")
    load.windowed_replace(spark, rows, target, *config.FULL_WINDOW, date_col="QuoteStartDate")
    return load.read_window(spark, target, *WW, date_col="QuoteCreatedDate").drop(load.MONTH_COL)


def _named_source(src, name: str, region_key: int, views) -> SourceViews:
    """A region of the fixture as a named source: its tables written to the
    shared folder in the source's own names and read back through the registry."""
    region = RegionalSources(src.spark, src.sf_dir, region_key)
    root = f"{shared_dir(src.spark)}/ledgerlight-src-{uuid.uuid4().hex}/{name}"
    for view in views:
        table, columns = VIEWS[view]
        (region[view].select(*[F.col(c).cast(kind).alias(column) for c, (column, kind) in columns.items()])
                     .write.parquet(f"{root}/{table}.parquet"))
    return SourceViews(src.spark, source_registry({name: {"path": root}})[name])


FREE_VIEWS = ("policy_full_src", "policy_src", "policy_status_dim", "product_dim", "quote_src",
              "sub_agent_dim", "state_dim", "user_dim")


@register("etl_named_source", (), ids="A1 A5 M6", oracle_fn=lambda: REGISTRY["fact_free_b"].oracle(config.FIXTURE_REGION_KEYS["UK"]))
def etl_named_source(src):
    """The UK's free-policy fact from a named source in the source's own tables."""
    views = _named_source(src, "uk", config.FIXTURE_REGION_KEYS["UK"], FREE_VIEWS)
    return facts.free_fact_b(views, *config.FULL_WINDOW, config.FIXTURE_DOMAIN)


SALES_VIEWS = ("policy_full_src", "policy_src", "cancel_src", "client_src", "product_dim", "quote_src", "user_dim",
               "hear_about_dim", "pet_type_dim")


@register("sales_named_source", (), ids="A1 A5 M4 J9 J10 J11 J13",
          oracle_fn=lambda: REGISTRY["fact_sales_b"].oracle(config.FIXTURE_REGION_KEYS["UK"]))
def sales_named_source(src):
    """The UK's sales fact from a named source: the window's keys cut
    cancellations, clients and quotes down before they are shuffled."""
    views = _named_source(src, "uk", config.FIXTURE_REGION_KEYS["UK"], SALES_VIEWS)
    return facts.sales_fact_b(views, *config.FULL_WINDOW, config.FIXTURE_DOMAIN)


# A target table with widths that the catalog declares.
WIDTHS = {"ProductName": 6, "ClientName": 9, "PetType": 3}


def _width_table(src) -> str:
    """The sales of the warehouse, loaded into a catalog table of VARCHARs."""
    spark = src.spark
    name = f"ll_widths_{uuid.uuid4().hex[:16]}"
    columns = ", ".join(f"{f.name} " + (f"VARCHAR({WIDTHS[f.name]})" if f.name in WIDTHS else f.dataType.simpleString())
                        for f in schemas.SALES.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}, {load.MONTH_COL} STRING) USING parquet "
              f"PARTITIONED BY ({load.MONTH_COL}) LOCATION '{shared_dir(spark)}/ledgerlight-tables/{name}'")
    rows = load.conform(src["sales_wh"], T.StructType([f for f in load.target_schema(spark, name).fields if f.name != load.MONTH_COL]))
    load.windowed_replace(spark, rows, name, *config.FULL_WINDOW)
    return name


@register("catalog_width_load", ("sales_wh",), ids="A8 B1 B3 B4", oracle="""
SELECT PolicyNumber, CreatedDate, substring(ProductName, 1, 6) AS ProductName,
       substring(ClientName, 1, 9) AS ClientName, substring(PetType, 1, 3) AS PetType, PetName
FROM sales_wh
""")
def catalog_width_load(src):
    """A load into a table with declared widths: longer values are cut."""
    return src.spark.table(_width_table(src)).select(
        "PolicyNumber", "CreatedDate", *WIDTHS, "PetName")


@register("catalog_width_cuts", ("sales_wh",), ids="A8 B3 B4", oracle="""
SELECT 'ProductName' AS column_name, 6 AS max_length, CAST(count_if(length(ProductName) > 6) AS BIGINT) AS cut_rows,
       CAST(max(length(ProductName)) AS INTEGER) AS max_seen FROM sales_wh
UNION ALL SELECT 'ClientName', 9, CAST(count_if(length(ClientName) > 9) AS BIGINT), CAST(max(length(ClientName)) AS INTEGER) FROM sales_wh
UNION ALL SELECT 'PetType', 3, CAST(count_if(length(PetType) > 3) AS BIGINT), CAST(max(length(PetType)) AS INTEGER) FROM sales_wh
""")
def catalog_width_cuts(src):
    """How many values of each limited column that load cuts, by the widths
    that the catalog gives back."""
    return load.truncation_report(src["sales_wh"], load.target_schema(src.spark, _width_table(src)))


@register("load_mismatch", ("sales_wh",), ids="B5", oracle="""
SELECT 'SaleMethod' AS column, 'extra' AS issue, count(SaleMethod) AS lost_values FROM sales_wh
UNION ALL SELECT 'Channel', 'missing', 0
UNION ALL SELECT 'PetName', 'extra', count(PetName) FROM sales_wh
""")
def load_mismatch(src):
    """Columns that a load would leave out, with the values lost, or leave empty."""
    target = T.StructType([f for f in src["sales_wh"].schema.fields if f.name not in ("SaleMethod", "PetName")]
                          + [T.StructField("Channel", T.StringType())])
    return load.mismatch_report(src["sales_wh"], target)


@register("snapshot_sales", (), ids="J9 J10 J11 J13 M4",
          oracle_fn=lambda: REGISTRY["fact_sales_b"].oracle(config.FIXTURE_REGION_KEYS["UK"]))
def snapshot_sales(src):
    """The UK's sales fact from a snapshot of its source, laid out by join key."""
    region = RegionalSources(src.spark, src.sf_dir, config.FIXTURE_REGION_KEYS["UK"])
    return facts.sales_fact_b(Snapshot(src.spark, region), *config.FULL_WINDOW, config.FIXTURE_DOMAIN)


@register("snapshot_quotes", (), ids="J3 J4 J5 M1",
          oracle_fn=lambda: REGISTRY["fact_quote_a"].oracle(config.FIXTURE_REGION_KEYS["NZ"]))
def snapshot_quotes(src):
    """New Zealand's quote fact from a snapshot of its source."""
    region = RegionalSources(src.spark, src.sf_dir, config.FIXTURE_REGION_KEYS["NZ"])
    return facts.quote_fact_a(Snapshot(src.spark, region), *config.FULL_WINDOW, config.FIXTURE_DOMAIN)


@register("target_name_check", (), ids="B8", oracle="""
SELECT p_type AS name, regexp_full_match(p_type, '[A-Za-z0-9_$]{1,128}') AS valid FROM part
UNION ALL SELECT replace(p_type, ' ', '_'), true FROM part
UNION ALL SELECT s_name, regexp_full_match(s_name, '[A-Za-z0-9_$]{1,128}') FROM supplier
""")
def target_name_check(src):
    """Which names that stand in tables could name a target."""
    types = src["part"].select(F.col("p_type").alias("name"))
    names = types.unionByName(types.select(F.replace("name", F.lit(" "), F.lit("_")).alias("name"))).unionByName(
        src["supplier"].select(F.col("s_name").alias("name")))
    return names.withColumn("valid", load.valid_name(F.col("name")))


@register("default_window_counts", ("quote_wh",), ids="K9 K10", oracle="""
SELECT count_if(CreatedDate >= DATE '2001-07-01') AS current_month,
       count_if(CreatedDate >= DATE '2001-06-01' AND CreatedDate < DATE '2001-07-01') AS previous_month,
       count_if(CreatedDate >= DATE '2000-01-01' AND CreatedDate < DATE '2001-01-01') AS previous_year,
       count_if(CreatedDate >= DATE '2001-01-10') AS six_months,
       count_if(CreatedDate >= DATE '2000-07-10') AS twelve_months,
       count_if(CreatedDate >= DATE '2000-07-10') AS etl_window
FROM quote_wh WHERE CreatedDate < DATE '2001-07-11'
""")
def default_window_counts(src):
    """Quotes of the windows that the reports take where none is given."""
    w = K.default_windows(config.AS_OF)
    first, today = w["first_day_of_current_month"], w["today"]
    until = {"current_month": (first, today), "six_months": (w["six_months_back"], today),
             "previous_month": (w["first_day_of_previous_month"], first - dt.timedelta(days=1)),
             "previous_year": (w["first_day_of_previous_year"], first.replace(month=1) - dt.timedelta(days=1)),
             "twelve_months": (w["twelve_months_back"], today), "etl_window": (w["etl_window_start"], today)}
    return src["quote_wh"].agg(*[F.count_if(K.in_window("CreatedDate", *span)).alias(name) for name, span in until.items()])


@register("listing_largest_page", ("quote_wh",), ids="D23 H3", oracle="""
SELECT QuoteNumber, CountryCode, CreatedDate, PetName FROM quote_wh
ORDER BY CreatedDate DESC NULLS LAST, QuoteNumber NULLS FIRST, CountryCode NULLS FIRST, PetName NULLS FIRST
LIMIT 10000 OFFSET 25
""")
def listing_largest_page(src):
    """The largest page that the guard lets through."""
    rows = src["quote_wh"].select("QuoteNumber", "CountryCode", "CreatedDate", "PetName")
    return paging.page(rows, [paging.desc("CreatedDate"), *paging.asc("QuoteNumber", "CountryCode", "PetName")],
                       skip="25", limit=config.MAX_PAGE_SIZE)


@register("report_positions", ("free_wh",), ids="H4 M18", oracle="""
WITH base AS (SELECT PolicyStatusName, PetType, SaleMethod FROM free_wh
              WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'),
g AS (SELECT 'status' AS level, PolicyStatusName AS name, count(*) AS value FROM base GROUP BY PolicyStatusName
      UNION ALL SELECT 'pet_type', PetType, count(*) FROM base GROUP BY PetType
      UNION ALL SELECT 'channel', SaleMethod, count(*) FROM base GROUP BY SaleMethod)
SELECT level, name, value, CAST(row_number() OVER (ORDER BY level, value DESC, name NULLS FIRST) AS BIGINT) AS position FROM g
""")
def report_positions(src):
    """The breakdown's rows with their place in the report."""
    parts = R.free_policy_breakdown(src["free_wh"], *WW).select("level", "name", "value")
    order = Window.orderBy("level", F.col("value").desc(), F.col("name").asc_nulls_first())  # a row a category
    return parts.withColumn("position", F.row_number().over(order).cast("bigint"))

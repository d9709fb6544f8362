"""Adapter views: give the driver's synthetic tables the shape of the
reference's source (OLTP) and warehouse tables.

Each adapter is one SQL text with ``{table}`` placeholders.  The same text is
run by Spark (``spark.sql(text, orders=df, ...)`` -- the placeholders are bound
to DataFrames, so no global temp view is registered) and, as a CTE, by the
DuckDB oracle.  Only functions with identical meaning in both engines are used:
``CASE``, ``concat``, ``lower``, ``%``, ``CAST(.. AS STRING)``, ``INTERVAL``.

Adapters derive every row from the base tables, so their size grows with the
scale factor.  Modulo expressions only shape values (NULLs, blanks, test rows);
they never filter rows away.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import shared_dir

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)

# --------------------------------------------------------------------------
# Source (OLTP) adapters
# --------------------------------------------------------------------------

ADAPTERS: dict[str, str] = {}

# Quote: one row per order.  Name/mail/pet fields are sometimes NULL, blank or
# "test" so the fallback, completeness and exclusion rules have work to do.
ADAPTERS["quote_src"] = """
SELECT o_orderkey AS id,
       o_custkey AS client_id,
       o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS created_date,
       o_orderdate AS quote_date,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE o_orderdate + INTERVAL 30 DAY END AS expire_date,
       CAST(o_orderkey % 200 AS INT) AS product_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1
            WHEN '3-MEDIUM' THEN 0 WHEN '5-LOW' THEN 3 END AS quote_save_from,
       concat('Q', CAST(o_orderkey AS STRING)) AS quote_number,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  '
            WHEN o_orderkey % 53 = 0 THEN 'test pet'
            ELSE concat(' Pet', CAST(o_custkey % 5 AS STRING), ' ') END AS pet_name,
       CASE WHEN o_orderkey % 19 = 0 THEN 0
            ELSE CAST(o_orderkey % 25 AS INT) END AS breed_id1,
       CAST(o_orderkey % 7 AS INT) AS breed_id2,
       CAST(o_orderkey % 3 AS INT) AS breed_id3,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL
            ELSE CAST(o_custkey % 5 AS INT) END AS hear_about_us,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL
            ELSE concat('F', CAST(o_custkey % 50 AS STRING)) END AS first_name,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'TESTER'
            ELSE concat('L', CAST(o_custkey % 30 AS STRING)) END AS last_name,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'x@Excluded.io'
            ELSE concat('u', CAST(o_custkey % 40 AS STRING), '@mail.org ') END AS email,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('+61 ', CAST(o_orderkey AS STRING))
            END AS mobile,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1 END AS created_by,
       CASE WHEN o_orderkey % 43 = 0 THEN o_orderkey - 1 END AS quote_parent_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 10 END AS executive_id,
       CASE WHEN o_orderkey % 59 = 0 THEN o_orderkey END AS migrated_quote_id,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE CAST(o_orderkey % 3 = 1 AS INT) END AS is_pet_id_product,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END AS sub_agent_id,
       o_orderdate - INTERVAL 700 DAY AS pet_birth_date,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Ms' END AS title,
       CASE WHEN o_orderkey % 2 = 0 THEN concat(CAST(o_orderkey AS STRING), ' Quote St') END AS address1,
       CASE WHEN o_orderkey % 4 = 2 THEN 'Flat 2' END AS address2,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Quoteville' END AS suburb,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(2000 + o_orderkey % 100 AS STRING) END AS post_code,
       CASE WHEN o_orderkey % 3 = 1 THEN concat('+44 ', CAST(o_orderkey AS STRING)) END AS primary_contact_number
FROM {orders}
"""

# Client: one row per customer, carries region (country) and nation (brand).
ADAPTERS["client_src"] = """
SELECT c_custkey AS id,
       c_name AS first_name,
       CASE WHEN c_custkey % 23 = 0 THEN 'Test' ELSE c_mktsegment END AS last_name,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            ELSE concat('U', CAST(c_custkey % 40 AS STRING), '@Mail.org') END AS email,
       concat(CAST(c_custkey AS STRING), ' Long Road') AS address1,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Unit 1' END AS address2,
       n_name AS suburb,
       CASE WHEN c_custkey % 29 = 0 THEN ' '
            ELSE CAST(1000 + c_custkey % 9000 AS STRING) END AS post_code,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            ELSE concat('+1 ', CAST(c_custkey AS STRING)) END AS primary_contact_number,
       CASE WHEN c_custkey % 14 = 0 THEN NULL
            ELSE concat('+2 ', CAST(c_custkey AS STRING)) END AS alternative_contact_number,
       c_custkey % 2 = 0 AS send_document_on_email,
       r_name AS country_code,
       n_name AS brand
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
                JOIN {region} ON r_regionkey = n_regionkey
"""

# Policy + PolicyActivity: one row per (order, line); the fixture repeats
# (l_orderkey, l_linenumber), so the adapter groups first and the id is unique.
ADAPTERS["policy_src"] = """
SELECT l_orderkey * 10 + l_linenumber AS id,
       l_orderkey AS quote_id,
       l_linenumber AS transaction_type_id,
       concat('P', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS policy_number,
       min(l_shipdate) AS created_date,
       CAST(min(l_partkey) % 200 AS INT) AS product_id,
       min(l_suppkey) AS sub_agent_id,
       min(l_returnflag) AS status,
       min(l_linestatus) AS channel,
       CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 31 = 0 THEN 'a Test activity'
            ELSE concat('ActivityPet', CAST(l_orderkey % 5 AS STRING)) END AS pet_name
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

# Policy attributes that the reference reads from Policy (not PolicyActivity).
ADAPTERS["policy_full_src"] = """
SELECT p.id, p.quote_id, p.transaction_type_id, p.policy_number, p.created_date,
       p.product_id, p.sub_agent_id, p.status, p.channel,
       o_custkey AS client_id,
       CASE WHEN p.sub_agent_id % 10 = 0 THEN NULL ELSE p.sub_agent_id % 10 END AS executive_id,
       CASE WHEN p.id % 3 = 0 THEN TRUE WHEN p.id % 3 = 1 THEN NULL ELSE FALSE END AS is_free_product,
       CASE WHEN p.quote_id % 41 = 0 THEN TRUE END AS is_migrated,
       CASE WHEN p.quote_id % 5 = 0 THEN 1 WHEN p.quote_id % 5 = 1 THEN NULL ELSE 0 END AS is_pet_id_product,
       CASE WHEN p.id % 13 = 0 THEN NULL WHEN p.id % 61 = 0 THEN 'TEST'
            ELSE concat('Pet', CAST(o_custkey % 5 AS STRING)) END AS pet_name,
       CASE WHEN p.id % 67 = 0 THEN 'test insured'
            ELSE concat('Insured ', CAST(o_custkey AS STRING)) END AS insured_name,
       p.created_date + INTERVAL 1 DAY AS actual_start_date,
       CASE WHEN p.id % 4 = 0 THEN p.created_date + INTERVAL 200 DAY
            ELSE p.created_date + INTERVAL 2500 DAY END AS actual_end_date,
       CAST(p.quote_id % 5 AS INT) AS policy_status_id
FROM {policy_src} p JOIN {orders} ON o_orderkey = p.quote_id
"""

# PolicyCancellation: 0..n per policy (fans out).
ADAPTERS["cancel_src"] = """
SELECT l_orderkey * 10 + l_linenumber AS id,
       l_orderkey * 10 + l_linenumber AS policy_id,
       l_shipdate AS created_date
FROM {lineitem} WHERE l_returnflag = 'R'
"""

# QuoteQuestionAnswer: every quote answers three questions.
ADAPTERS["answer_src"] = """
SELECT o_orderkey * 3 AS id, o_orderkey AS quote_id, 501 AS question_id FROM {orders}
UNION ALL
SELECT o_orderkey * 3 + 1 AS id, o_orderkey AS quote_id, 502 AS question_id FROM {orders}
UNION ALL
SELECT o_orderkey * 3 + 2 AS id, o_orderkey AS quote_id, 503 AS question_id FROM {orders}
"""

# QuoteQuestionAnswerDetail: the comma-separated answer column, with bad tokens.
ADAPTERS["list_src"] = """
SELECT id AS answer_id,
       concat(CAST(id % 200 AS STRING), ', ', CAST((id * 7) % 200 AS STRING),
              CASE WHEN id % 10 = 0 THEN ',x' ELSE '' END) AS answer
FROM {answer_src}
"""

# Dimensions.
ADAPTERS["product_dim"] = """
SELECT CAST(p_partkey AS INT) AS id,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS INT) END AS parent_product_id,
       CASE WHEN p_partkey % 15 = 0 THEN concat(p_name, ' Introductory') ELSE p_name END AS product_name,
       CASE p_partkey % 7 WHEN 0 THEN 'CAT-STD' WHEN 1 THEN 'dog-plus' WHEN 2 THEN 'EQUINE-1'
            WHEN 3 THEN 'HORSE-2' WHEN 4 THEN 'EXOTIC' WHEN 5 THEN 'PROF-BB_COM' END AS product_code,
       CAST(p_partkey % 8 AS INT) AS pet_type_id,
       p_partkey % 9 = 0 AS is_free_product
FROM {part}
"""
ADAPTERS["pet_type_dim"] = "SELECT n_nationkey AS pet_type_id, n_name AS pet_type_name FROM {nation}"
ADAPTERS["breed_dim"] = "SELECT CAST(p_partkey AS INT) AS id, p_name AS breed_name FROM {part}"
ADAPTERS["question_dim"] = "SELECT CAST(p_partkey AS INT) AS id, p_name AS question_detail_name FROM {part}"
ADAPTERS["hear_about_dim"] = "SELECT r_regionkey AS id, r_name AS name FROM {region}"
ADAPTERS["policy_status_dim"] = "SELECT r_regionkey AS id, r_name AS policy_status_name FROM {region}"
ADAPTERS["state_dim"] = "SELECT n_nationkey AS id, n_name AS state_name FROM {nation}"
ADAPTERS["sub_agent_dim"] = """
SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 10 AS INT) AS agent_category_id,
       CASE WHEN s_suppkey % 7 = 3 THEN 'agent.TEST@mail.org' WHEN s_suppkey % 13 = 5 THEN 'staff@excluded.org'
            WHEN s_suppkey % 11 = 4 THEN NULL
            ELSE concat('agent', CAST(s_suppkey AS STRING), '@mail.org') END AS email,
       s_nationkey AS state_id
FROM {supplier}
"""
ADAPTERS["user_dim"] = """
SELECT s_suppkey AS id,
       CASE s_suppkey % 4 WHEN 0 THEN 'FIT' WHEN 1 THEN 'Web' ELSE s_name END AS first_name
FROM {supplier}
"""

# --------------------------------------------------------------------------
# Warehouse adapters (what the reports read)
# --------------------------------------------------------------------------

# Warehouse Quote table: one row per order, region = country, segment = brand.
ADAPTERS["quote_wh"] = """
SELECT r_name AS CountryCode,
       lower(r_name) AS CountryName,
       c_mktsegment AS Brand,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL
            ELSE concat('Q', CAST(o_orderkey AS STRING)) END AS QuoteNumber,
       o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS CreatedDate,
       o_orderdate AS QuoteStartDate,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE o_orderdate + INTERVAL 30 DAY END AS QuoteExpiryDate,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Web' WHEN '2-HIGH' THEN 'Phone'
            WHEN '3-MEDIUM' THEN 'Contact Center' WHEN '4-NOT SPECIFIED' THEN ' WEB '
            END AS QuoteReceivedMethod,
       CASE WHEN pol.quote_id IS NULL THEN NULL WHEN o_orderkey % 29 = 0 THEN 'None'
            ELSE concat('P', CAST(o_orderkey AS STRING)) END AS PolicyNumber,
       pol.policy_created AS PolicyCreatedDate,
       pol.policy_created + INTERVAL 1 DAY AS PolicyStartDate,
       pol.policy_created + INTERVAL 366 DAY AS PolicyEndDate,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_name END AS FullName,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            ELSE concat('u', CAST(c_custkey % 40 AS STRING), '@mail.org') END AS Email,
       CASE WHEN o_orderkey % 17 = 0 THEN ' , '
            ELSE concat(CAST(o_orderkey AS STRING), ' Main St, ') END AS Address,
       n_name AS Suburb,
       CASE WHEN o_orderkey % 41 = 0 THEN ''
            ELSE CAST(1000 + c_custkey % 9000 AS STRING) END AS PostCode,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL
            ELSE concat('+1 ', CAST(o_custkey AS STRING)) END AS ContactNo,
       CASE WHEN o_orderkey % 23 = 0 THEN '  '
            ELSE concat('Pet', CAST(o_custkey % 5 AS STRING)) END AS PetName,
       CASE o_orderkey % 8 WHEN 0 THEN 'Cat' WHEN 1 THEN 'Dog' WHEN 2 THEN 'Horse'
            WHEN 3 THEN 'Exotic' WHEN 4 THEN 'BB_Commercial' WHEN 5 THEN NULL
            WHEN 6 THEN 'bbXcom' ELSE 'Bird' END AS PetType,
       o_orderdate - INTERVAL 700 DAY AS PetBirthDate,
       concat('Breed', CAST(o_orderkey % 50 AS STRING)) AS BreedName
FROM {orders}
JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} ON n_nationkey = c_nationkey
JOIN {region} ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_orderkey AS quote_id, min(l_shipdate) AS policy_created
           FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY l_orderkey) pol
       ON pol.quote_id = o_orderkey
"""

# Warehouse Sales table: one row per policy (order line).
ADAPTERS["sales_wh"] = """
SELECT cl.country_code AS CountryCode,
       lower(cl.country_code) AS CountryName,
       cl.last_name AS Brand,
       p.policy_number AS PolicyNumber,
       p.created_date AS CreatedDate,
       p.created_date + INTERVAL 1 DAY AS ActualStartDate,
       concat('Product ', CAST(p.product_id AS STRING)) AS ProductName,
       CASE p.product_id % 7 WHEN 0 THEN 'Cat' WHEN 1 THEN 'Dog' WHEN 2 THEN 'Horse'
            WHEN 3 THEN 'Exotic' WHEN 4 THEN 'BB_Commercial' WHEN 5 THEN 'OTHER'
            ELSE NULL END AS PetType,
       cl.first_name AS ClientName,
       concat('Pet', CAST(p.quote_id % 5 AS STRING)) AS PetName,
       CASE p.status WHEN 'A' THEN 'Web' WHEN 'N' THEN 'Phone' ELSE 'contact_center' END AS SaleMethod,
       concat('Q', CAST(p.quote_id AS STRING)) AS QuoteNumber,
       o_orderdate AS QuoteCreatedDate
FROM {policy_src} p
JOIN {orders} ON o_orderkey = p.quote_id
JOIN {client_src} cl ON cl.id = o_custkey
"""

# Warehouse FreePolicySales table.
ADAPTERS["free_wh"] = """
SELECT cl.country_code AS CountryCode,
       lower(cl.country_code) AS CountryName,
       cl.last_name AS Brand,
       concat('Q', CAST(p.quote_id AS STRING)) AS QuoteNumber,
       p.policy_number AS PolicyNumber,
       p.created_date AS CreatedDate,
       concat('Agent ', CAST(p.sub_agent_id % 10 AS STRING)) AS SubAgentName,
       CAST(p.sub_agent_id % 10 AS INT) AS AgentCategoryId,
       CASE p.product_id % 6 WHEN 0 THEN 'Cat' WHEN 1 THEN 'Dog' WHEN 2 THEN 'Horse'
            WHEN 3 THEN 'Exotic' WHEN 4 THEN 'BB' ELSE 'Others' END AS PetType,
       concat('Product ', CAST(p.product_id AS STRING)) AS ProductName,
       cl.suburb AS StateName,
       CASE p.channel WHEN 'O' THEN 'Web' ELSE 'Phone' END AS SaleMethod,
       CASE WHEN p.quote_id % 17 = 0 THEN NULL
            ELSE CASE p.status WHEN 'R' THEN 'Cancelled' WHEN 'A' THEN 'Active'
                 ELSE 'Pending' END END AS PolicyStatusName
FROM {policy_src} p
JOIN {orders} ON o_orderkey = p.quote_id
JOIN {client_src} cl ON cl.id = o_custkey
"""

# Warehouse CRM table: one row per order (customer 360 row).
ADAPTERS["crm_wh"] = """
SELECT cl.last_name AS Brand,
       CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL
            ELSE lower(cl.country_code) END AS Country,
       '' AS BusinessName, '' AS BusinessType,
       CASE WHEN pol.quote_id IS NULL THEN 'Quote'
            WHEN o_orderkey % 4 = 0 THEN 'Expired'
            WHEN o_orderkey % 4 = 1 THEN 'Active'
            ELSE 'Cancelled' END AS CustomerStatus,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS FreePolicy,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '2001-07-10 00:00:00' THEN 'Lapsed'
            ELSE 'Live' END AS QuoteStatus,
       concat('Q', CAST(o_orderkey AS STRING)) AS QuoteNumber,
       CASE WHEN pol.quote_id IS NOT NULL
            THEN concat('P', CAST(o_orderkey AS STRING)) END AS PolicyNumber,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Web' ELSE 'Phone' END AS QuoteReceivedMethod,
       o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS QuoteCreatedDate,
       o_orderdate AS QuoteStartDate,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE o_orderdate + INTERVAL 30 DAY END AS QuoteEndDate,
       pol.policy_created + INTERVAL 1 DAY AS OriginalPolicyStartDate,
       pol.policy_created + INTERVAL 366 DAY AS PolicyEndDate,
       concat('F', CAST(o_custkey % 50 AS STRING)) AS FirstName,
       concat('L', CAST(o_custkey % 30 AS STRING)) AS LastName,
       cl.email AS Email,
       cl.primary_contact_number AS ContactNo,
       CASE WHEN cl.send_document_on_email THEN 'Yes' ELSE 'No' END AS EmailConcent,
       concat('Pet', CAST(o_custkey % 5 AS STRING)) AS PetName,
       CASE o_orderkey % 6 WHEN 0 THEN 'Cat' WHEN 1 THEN 'Dog' WHEN 2 THEN 'Horse'
            WHEN 3 THEN 'Exotic' WHEN 4 THEN 'BB_Commercial' ELSE 'OTHER' END AS PetType,
       o_orderdate - INTERVAL 700 DAY AS PetBirthDate,
       CAST(o_orderkey % 25 AS INT) AS PetBreedId,
       concat('Breed', CAST(o_orderkey % 25 AS STRING)) AS BreedName,
       cl.country_code AS CountryCode
FROM {orders}
JOIN {client_src} cl ON cl.id = o_custkey
LEFT JOIN (SELECT l_orderkey AS quote_id, min(l_shipdate) AS policy_created
           FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY l_orderkey) pol
       ON pol.quote_id = o_orderkey
"""

# Which other adapters each adapter reads (resolved recursively).
_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def dependencies(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(ADAPTERS[name])))


def adapter_order(names) -> list[str]:
    """Topological order of the adapters needed for ``names``."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in seen:
            return
        for d in dependencies(n):
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


# --------------------------------------------------------------------------
# Regional sources: the fixture carved into one "database" per region
# --------------------------------------------------------------------------

# A region's source holds the customers of that region, their orders and the
# lines of those orders; dimension tables are shared.  Applied to the base
# tables, so every adapter above follows.
REGIONAL_TABLES: dict[str, str] = {
    "customer": """
SELECT c.* FROM {customer} c
WHERE c.c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = {region_key})
""",
    "orders": """
SELECT o.* FROM {orders} o WHERE o.o_custkey IN (SELECT c_custkey FROM {customer_r})
""",
    "lineitem": """
SELECT l.* FROM {lineitem} l WHERE l.l_orderkey IN (SELECT o_orderkey FROM {orders_r})
""",
}


def _regional_text(table: str, region_key: int) -> str:
    return REGIONAL_TABLES[table].replace("{region_key}", str(int(region_key)))


def oracle_ctes(names, region_key: int | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for DuckDB text.  With a
    ``region_key`` the base tables customer/orders/lineitem are the region's
    slices (``customer_r``, ``orders_r``, ``lineitem_r``)."""
    parts = []
    base = {t: t for t in BASE_TABLES}
    if region_key is not None:
        names_r = {"customer": "customer_r", "orders": "orders_r", "lineitem": "lineitem_r"}
        for t in ("customer", "orders", "lineitem"):
            text = _PLACEHOLDER.sub(lambda m: m.group(1), _regional_text(t, region_key)).strip()
            parts.append(f"{names_r[t]} AS (\n{text}\n)")
        base.update(names_r)
    for n in adapter_order(names):
        body = _PLACEHOLDER.sub(lambda m: base.get(m.group(1), m.group(1)), ADAPTERS[n]).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Sources:
    """Lazily reads base tables and adapter views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def _base(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self._base(name)
            elif name in ADAPTERS:
                deps = {d: self[d] for d in dependencies(name)}
                self._cache[name] = self.spark.sql(ADAPTERS[name], **deps)
            else:
                raise KeyError(name)
        return self._cache[name]


class RegionalTables:
    """The large tables of several regions: each is read once, by its first use,
    and written to the shared folder by region, so that no region reads the rows
    of the others.  A row belongs to every region that ``REGIONAL_TABLES`` gives
    it to."""

    # Table -> (its key to the table above, that table, the key there).
    PARENTS = {"customer": ("c_nationkey", "nation", "n_nationkey"),
               "orders": ("o_custkey", "customer", "c_custkey"),
               "lineitem": ("l_orderkey", "orders", "o_orderkey")}

    def __init__(self, spark: SparkSession, sf_dir: str, region_keys: Iterable[int]):
        self.spark, self.sf_dir = spark, sf_dir
        self.region_keys = sorted({int(k) for k in region_keys})
        self.paths: dict[str, str] = {}

    def _members(self, name: str, key: str) -> DataFrame:
        """``_key, _regions``: the regions that the rows with a key belong to."""
        if name == "nation":
            rows = read_table(self.spark, self.sf_dir, name).select("n_nationkey", F.col("n_regionkey").alias("_region"))
            rows = rows.where(F.col("_region").isin(self.region_keys))
        else:
            rows = self._written(name)
        return (rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
                .agg(F.collect_set(F.col("_region").cast("int")).alias("_regions")))

    def _written(self, name: str) -> DataFrame:
        raw = read_table(self.spark, self.sf_dir, name)
        if name not in self.paths:
            own, parent, key = self.PARENTS[name]
            rows = raw.join(self._members(parent, key), F.col(own) == F.col("_key"))
            path = f"{shared_dir(self.spark)}/_regions/{uuid.uuid4().hex}/{name}"
            rows.select(*raw.columns, F.explode("_regions").alias("_region")).write.partitionBy("_region").parquet(path)
            self.paths[name] = path
        return self.spark.read.schema(T.StructType([*raw.schema, T.StructField("_region", T.IntegerType())])).parquet(self.paths[name])

    def table(self, name: str, region_key: int) -> DataFrame:
        return self._written(name).where(F.col("_region") == region_key).drop("_region")


class RegionalSources(Sources):
    """One region's source database carved out of the fixture folder: its
    customers, their orders and order lines (semi joins, or the parts that
    ``tables`` has written for several regions), shared dimensions."""

    def __init__(self, spark: SparkSession, sf_dir: str, region_key: int, tables: RegionalTables | None = None):
        super().__init__(spark, sf_dir)
        self.region_key = int(region_key)
        self.tables = tables

    def _base(self, name: str) -> DataFrame:
        if self.tables is not None and name in RegionalTables.PARENTS:
            return self.tables.table(name, self.region_key)
        raw = read_table(self.spark, self.sf_dir, name)
        if name == "customer":
            return self.spark.sql(_regional_text("customer", self.region_key),
                                  customer=raw, nation=self["nation"])
        if name == "orders":
            return self.spark.sql(_regional_text("orders", self.region_key),
                                  orders=raw, customer_r=self["customer"])
        if name == "lineitem":
            return self.spark.sql(_regional_text("lineitem", self.region_key),
                                  lineitem=raw, orders_r=self["orders"])
        return raw


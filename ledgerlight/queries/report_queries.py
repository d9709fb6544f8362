"""Driver queries for the reports (M9-M23) with their DuckDB oracles."""

from __future__ import annotations

import datetime as dt


from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.operators import paging, reshape
from ledgerlight.plans import reports as R
from ledgerlight.registry import REGISTRY, register

AS_OF = config.AS_OF
MW = config.MONTH_WINDOW          # 2001-06-05 .. 2001-06-20
WW = config.WIDE_WINDOW           # 2001-01-15 .. 2001-06-20
XW = config.CROSSING_WINDOW       # 2001-05-20 .. 2001-06-10
EW = config.MONTH_END_WINDOW      # 2001-01-31 .. 2001-02-28
COUNTRIES = "africa, Asia ,EUROPE"
PETS = "Cat,dog,bbc,unknown"
EXTRACTED_AT = dt.datetime(2001, 7, 10, 12, 0, 0)

# Shared oracle fragments -------------------------------------------------
FLT = ("upper(CountryCode) IN ('AFRICA', 'ASIA', 'EUROPE') AND "
       "(lower(coalesce(PetType, '')) LIKE '%cat%' OR lower(coalesce(PetType, '')) LIKE '%dog%' "
       "OR lower(coalesce(PetType, '')) LIKE '%bb_com%')")
BUCKET = """CASE WHEN lower(coalesce(PetType, '')) LIKE '%cat%' THEN 'Cat'
                 WHEN lower(coalesce(PetType, '')) LIKE '%dog%' THEN 'Dog'
                 WHEN lower(coalesce(PetType, '')) LIKE '%horse%' THEN 'Horse'
                 WHEN lower(coalesce(PetType, '')) LIKE '%exotic%' THEN 'Exotic'
                 WHEN lower(coalesce(PetType, '')) LIKE '%bb_com%' THEN 'BB'
                 ELSE 'Others' END"""
INCOMPLETE = """(nullif(trim(FullName), '') IS NULL OR nullif(trim(Email), '') IS NULL
   OR nullif(trim(Address), '') IS NULL OR nullif(trim(PostCode), '') IS NULL
   OR nullif(trim(ContactNo), '') IS NULL OR nullif(trim(PetType), '') IS NULL
   OR nullif(trim(PetName), '') IS NULL)"""
OPEN_QUOTE = "(PolicyNumber IS NULL OR PolicyNumber ILIKE '%none%')"
METHOD = """coalesce(CASE WHEN lower(trim(m)) IN ('contact center', 'contact_center') THEN 'phone'
                     ELSE lower(trim(m)) END, 'none')"""


@register("kpi_summary", ("quote_wh",), ids="M9 F1 D16 K1 K2 K3 N10", oracle=f"""
SELECT cur AS currentPeriodTotalQuotes, prev AS lastPeriodTotalQuotes,
       live AS liveQuotes, lapsed AS lapsedQuotes, inc AS incompleteQuoteDetails,
       CASE WHEN cur = 0 THEN '0'
            WHEN n % 10 = 0 THEN CAST(CAST(floor(n / 10) AS BIGINT) AS VARCHAR)
            ELSE concat(CAST(CAST(floor(n / 10) AS BIGINT) AS VARCHAR), '.', CAST(n % 10 AS VARCHAR))
       END AS quotesCompleteness
FROM (
  SELECT *, CASE WHEN cur > 0 THEN CAST(floor((2000 * (cur - inc) + cur) / (2 * cur)) AS BIGINT) END AS n
  FROM (
    SELECT
      CAST(count_if(CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21') AS BIGINT) AS cur,
      CAST(count_if(CreatedDate >= DATE '2001-05-05' AND CreatedDate < DATE '2001-05-21') AS BIGINT) AS prev,
      CAST(count_if(CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
               AND DATE '2001-07-10' <= QuoteExpiryDate AND {OPEN_QUOTE}) AS BIGINT) AS live,
      CAST(count_if(CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
               AND DATE '2001-07-10' > QuoteExpiryDate AND {OPEN_QUOTE}) AS BIGINT) AS lapsed,
      CAST(count_if(CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
               AND {INCOMPLETE}) AS BIGINT) AS inc
    FROM quote_wh WHERE {FLT}))
""")
def kpi_summary(src):
    return R.quote_kpis(src["quote_wh"], *MW, AS_OF, COUNTRIES, "all", PETS)


def _series_oracle(table: str, count_col: str, lo: str, hi: str, day_pred: str, flt: str) -> str:
    return f"""
WITH cal AS (SELECT CAST(m AS DATE) AS month
             FROM generate_series(DATE '{lo}', DATE '{hi}' - INTERVAL 1 MONTH, INTERVAL 1 MONTH) t(m)),
agg AS (SELECT CAST(date_trunc('month', CreatedDate) AS DATE) AS month, count({count_col}) AS value
        FROM {table}
        WHERE CreatedDate >= DATE '{lo}' AND CreatedDate < DATE '{hi}' AND {flt} {day_pred}
        GROUP BY 1)
SELECT strftime(cal.month, '%Y-%m') AS period, strftime(cal.month, '%b %y') AS month_label,
       CAST(coalesce(agg.value, 0) AS BIGINT) AS value
FROM cal LEFT JOIN agg ON agg.month = cal.month
"""


@register("series_13m_wrap", ("quote_wh",), ids="M9 F5 K4 K6 K-wrap K8 J28 K7",
          oracle=_series_oracle("quote_wh", "QuoteNumber", "2000-06-01", "2001-07-01",
                                "AND day(CreatedDate) BETWEEN 5 AND 20", FLT))
def series_13m_wrap(src):
    return R.monthly_series(src.spark, src["quote_wh"], "CreatedDate", "QuoteNumber", *MW,
                            COUNTRIES, "all", PETS)


@register("series_13m_full", ("quote_wh",), ids="M9 F5 K4 K6 K8",
          oracle=_series_oracle("quote_wh", "QuoteNumber", "2000-06-01", "2001-07-01", "", "TRUE"))
def series_13m_full(src):
    return R.monthly_series(src.spark, src["quote_wh"], "CreatedDate", "QuoteNumber", *WW)


@register("sales_series_13m", ("sales_wh",), ids="M16 F5 K4 K6 K-wrap K8",
          oracle=_series_oracle("sales_wh", "PolicyNumber", "2000-06-01", "2001-07-01",
                                "AND day(CreatedDate) BETWEEN 5 AND 20", "TRUE"))
def sales_series_13m(src):
    return R.monthly_series(src.spark, src["sales_wh"], "CreatedDate", "PolicyNumber", *MW)


@register("count_by_bucket", ("quote_wh",), ids="M11 F4 C14", oracle=f"""
SELECT {BUCKET} AS name, count(QuoteNumber) AS value
FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
GROUP BY 1
""")
def count_by_bucket(src):
    return R.count_by_pet_bucket(src["quote_wh"], "QuoteNumber", *WW)


@register("sales_by_bucket", ("sales_wh",), ids="M17 F4 C14 F12", oracle=f"""
WITH b AS (SELECT {BUCKET} AS name, count(PolicyNumber) AS value
           FROM sales_wh
           WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
             AND upper(CountryCode) IN ('AFRICA', 'ASIA', 'EUROPE')
           GROUP BY 1)
SELECT name, value, CAST(sum(value) OVER () AS BIGINT) AS total FROM b
""")
def sales_by_bucket(src):
    by = R.count_by_pet_bucket(src["sales_wh"], "PolicyNumber", *WW, countries=COUNTRIES)
    return paging.attach_scalars(by, R.bucket_total(by))


def _conversion_oracle(cte: str) -> str:
    return f"""
WITH {cte}
SELECT CAST(tq AS BIGINT) AS total_quotes, CAST(cv AS BIGINT) AS converted,
       CASE WHEN tq > 0 THEN floor((20000 * cv + tq) / (2 * tq)) / 100.0 ELSE 0.0 END AS conversion_percent,
       CAST(greatest(tq - cv, 0) AS BIGINT) AS not_converted,
       CASE WHEN tq > 0 THEN (10000 - floor((20000 * cv + tq) / (2 * tq))) / 100.0 ELSE 0.0 END
         AS not_converted_percent
FROM c
"""


@register("conversion_same_period", ("quote_wh",), ids="M13 F2 D17", oracle=_conversion_oracle(f"""
c AS (SELECT count(QuoteNumber) AS tq,
             count_if(NOT {OPEN_QUOTE} AND PolicyCreatedDate >= DATE '2001-01-15'
                      AND PolicyCreatedDate < DATE '2001-06-21') AS cv
      FROM quote_wh
      WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21' AND {FLT})
"""))
def conversion_same_period(src):
    return R.conversion_same_period(src["quote_wh"], *WW, COUNTRIES, "all", PETS)


@register("conversion_v2", ("quote_wh", "sales_wh"), ids="M13 N22 H5 A7", oracle=_conversion_oracle("""
c AS (SELECT (SELECT count(QuoteNumber) FROM quote_wh
              WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21') AS tq,
             (SELECT count(PolicyNumber) FROM sales_wh
              WHERE CreatedDate >= DATE '2001-06-01' AND CreatedDate < DATE '2001-07-01'
                AND day(CreatedDate) BETWEEN 5 AND 20) AS cv)
"""))
def conversion_v2(src):
    return R.conversion_v2(src.spark, src["quote_wh"], src["sales_wh"], *MW)


def _clamp(col: str, s: int, e: int) -> str:
    eom = f"day(last_day({col}))"
    return f"day({col}) >= least({s}, {eom}) AND day({col}) <= least({e}, {eom})"


def _trend_oracle(table: str, method_col: str, count_col: str, lo: str, hi_excl: str,
                  cal_lo: str, cal_hi: str, day_pred: str) -> str:
    m = METHOD.replace("m)", f"{method_col})")
    return f"""
WITH agg AS (SELECT {m} AS method, CAST(date_trunc('month', CreatedDate) AS DATE) AS month,
                    count({count_col}) AS value
             FROM {table}
             WHERE CreatedDate >= DATE '{lo}' AND CreatedDate < DATE '{hi_excl}' {day_pred}
             GROUP BY {method_col}, 2),
wide AS (SELECT month, sum(CASE WHEN method = 'web' THEN value END) AS web,
                sum(CASE WHEN method = 'phone' THEN value END) AS phone
         FROM agg GROUP BY month),
cal AS (SELECT CAST(m AS DATE) AS month FROM generate_series(DATE '{cal_lo}', DATE '{cal_hi}', INTERVAL 1 MONTH) t(m)
        WHERE EXISTS (SELECT 1 FROM agg))
SELECT strftime(cal.month, '%Y-%m') AS period, strftime(cal.month, '%b %y') AS month_label,
       CAST(coalesce(wide.web, 0) AS BIGINT) AS web, CAST(coalesce(wide.phone, 0) AS BIGINT) AS phone
FROM cal LEFT JOIN wide ON wide.month = cal.month
"""


@register("method_trend_pivot", ("quote_wh",), ids="M15 F6 L1 L2 K5 K-clamp K8 J28",
          oracle=_trend_oracle("quote_wh", "QuoteReceivedMethod", "QuoteNumber", "2000-12-05",
                               "2001-06-21", "2000-12-01", "2001-06-01",
                               "AND " + _clamp("CreatedDate", 5, 20)))
def method_trend_pivot(src):
    return R.method_trend(src.spark, src["quote_wh"], "QuoteReceivedMethod", "QuoteNumber", *MW)


@register("sales_method_trend", ("sales_wh",), ids="M21 F6 L1 K5 K8",
          oracle=_trend_oracle("sales_wh", "SaleMethod", "PolicyNumber", "2000-12-15",
                               "2001-06-21", "2000-12-01", "2001-06-01", ""))
def sales_method_trend(src):
    return R.method_trend(src.spark, src["sales_wh"], "SaleMethod", "PolicyNumber", *WW)


@register("method_month_end_trend", ("quote_wh",), ids="M15 K5 K-clamp (31..28)",
          oracle=_trend_oracle("quote_wh", "QuoteReceivedMethod", "QuoteNumber", "2000-08-31",
                               "2001-03-01", "2000-08-01", "2001-02-01", ""))
def method_month_end_trend(src):
    return R.method_trend(src.spark, src["quote_wh"], "QuoteReceivedMethod", "QuoteNumber", *EW)


@register("method_period_totals", ("quote_wh",), ids="M15 F8 F11 L3", oracle=f"""
SELECT {METHOD.replace('m)', 'QuoteReceivedMethod)')} AS method,
       CAST(count(CASE WHEN CreatedDate >= DATE '2000-12-05' AND {_clamp('CreatedDate', 5, 20)}
                       THEN QuoteNumber END) AS BIGINT) AS total,
       CAST(count(CASE WHEN CreatedDate >= DATE '2001-06-05' THEN QuoteNumber END) AS BIGINT) AS period_total
FROM quote_wh
WHERE CreatedDate >= DATE '2000-12-05' AND CreatedDate < DATE '2001-06-21'
GROUP BY 1
HAVING total > 0 OR period_total > 0
""")
def method_period_totals(src):
    return R.method_totals(src["quote_wh"], "QuoteReceivedMethod", "QuoteNumber", *MW)


@register("total_quotes", ("quote_wh",), ids="M15", oracle=f"""
SELECT CAST(count(QuoteNumber) AS BIGINT) AS total_quotes FROM quote_wh
WHERE CreatedDate >= DATE '2000-12-05' AND CreatedDate < DATE '2001-06-21' AND {_clamp('CreatedDate', 5, 20)}
""")
def total_quotes(src):
    totals = R.method_totals(src["quote_wh"], "QuoteReceivedMethod", "QuoteNumber", *MW)
    return R.grand_total(totals, "total", "total_quotes")


@register("breakdown_share", ("free_wh",), ids="M18 F10 G9", oracle="""
WITH base AS (SELECT PolicyStatusName, PetType, SaleMethod FROM free_wh
              WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'),
g AS (SELECT 'status' AS level, PolicyStatusName AS name, count(*) AS value FROM base GROUP BY PolicyStatusName
      UNION ALL
      SELECT 'pet_type', PetType, count(*) FROM base GROUP BY PetType
      UNION ALL
      SELECT 'channel', SaleMethod, count(*) FROM base GROUP BY SaleMethod)
SELECT level, name, CAST(value AS BIGINT) AS value,
       CAST(100.0 * value / nullif(sum(value) OVER (PARTITION BY level), 0) AS DECIMAL(5,1)) AS PctOfTotal
FROM g
""")
def breakdown_share(src):
    return R.free_policy_breakdown(src["free_wh"], *WW)


def _policy_trend_oracle(basis: str, lo: str, hi_excl: str, s: int, e: int, extra: str) -> str:
    return f"""
WITH agg AS (SELECT CAST(date_trunc('month', {basis}) AS DATE) AS month, count(*) AS policyCount
             FROM crm_wh
             WHERE {basis} >= DATE '{lo}' AND {basis} < DATE '{hi_excl}' AND {_clamp(basis, s, e)} {extra}
             GROUP BY 1),
cal AS (SELECT CAST(m AS DATE) AS month
        FROM (SELECT min(month) AS lo, max(month) AS hi FROM agg) b,
             generate_series(b.lo, b.hi, INTERVAL 1 MONTH) t(m)
        WHERE b.lo IS NOT NULL)
SELECT strftime(cal.month, '%Y-%m') AS period, strftime(cal.month, '%b %y') AS month_label,
       CAST(coalesce(agg.policyCount, 0) AS BIGINT) AS policyCount
FROM cal LEFT JOIN agg ON agg.month = cal.month
"""


@register("policy_month_trend", ("crm_wh",), ids="M22 F7 D18 D19 D20 D21 K5 K-clamp K8",
          oracle=_policy_trend_oracle(
              "OriginalPolicyStartDate", "2000-08-15", "2001-06-21", 15, 20,
              "AND CountryCode IN ('AFRICA', 'ASIA') AND CustomerStatus IN ('Active', 'Expired') "
              "AND FreePolicy = 'No'"))
def policy_month_trend(src):
    return R.policy_month_trend(src["crm_wh"], *WW, months=11, date_basis="OriginalPolicyStartDate",
                                regions="AFRICA,ASIA", policy_status=["Active", " Expired "],
                                policy_type="no")


@register("policy_trend_collated", ("crm_wh",), ids="M22 D19 D20 N3",
          oracle=_policy_trend_oracle(
              "OriginalPolicyStartDate", "2000-08-15", "2001-06-21", 15, 20,
              "AND lower(rtrim(CustomerStatus)) IN ('active', 'expired') AND lower(rtrim(FreePolicy)) = 'no'"))
def policy_trend_collated(src):
    """Statuses are found whatever their case."""
    return R.policy_month_trend(src["crm_wh"], *WW, months=11, date_basis="OriginalPolicyStartDate",
                                policy_status=["ACTIVE", "expired"], policy_type="no", collation=config.NOCASE_KEYS)


@register("policy_trend_default_basis", ("crm_wh",), ids="M22 D18 (bad basis -> default) K-clamp",
          oracle=_policy_trend_oracle("QuoteCreatedDate", "2001-01-31", "2001-03-01", 31, 28,
                                      "AND (lower(coalesce(PetType, '')) LIKE '%bb_com%')"))
def policy_trend_default_basis(src):
    return R.policy_month_trend(src["crm_wh"], *EW, months=None, date_basis="NoSuchColumn",
                                pets="bbcom")


LISTING_Q = ["CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteStatus", "ConvertedQuote",
             "QuoteDetailsCompleted", "CreatedDate", "QuoteStartDate", "QuoteExpiryDate",
             "QuoteReceivedMethod", "FullName", "Email", "ContactNo", "PetName", "PetType",
             "BreedName", "PetBirthDate"]


def _order_sql(cols, first="CreatedDate DESC NULLS LAST", second="QuoteNumber ASC NULLS FIRST") -> str:
    rest = [f"{c} ASC NULLS FIRST" for c in cols
            if c not in (first.split()[0], second.split()[0])]
    return ", ".join([first, second, *rest])


QUOTE_EXPR = {
    "QuoteStatus": """CASE WHEN coalesce(QuoteExpiryDate, QuoteStartDate) IS NULL THEN NULL
              WHEN DATE '2001-07-10' > QuoteExpiryDate THEN 'Lapsed' ELSE 'Live' END""",
    "ConvertedQuote": f"CASE WHEN {OPEN_QUOTE} THEN 'No' ELSE 'Yes' END",
    "QuoteDetailsCompleted": f"CASE WHEN {INCOMPLETE} THEN 'No' ELSE 'Yes' END",
    "QuoteCreatedDate": "CreatedDate",
}


def quote_rows_sql(shape: str, lo: str, hi_excl: str, where: str = "") -> str:
    cols = R.QUOTE_SHAPES[shape]
    sel = ",\n         ".join(f"{QUOTE_EXPR[c]} AS {c}" if c in QUOTE_EXPR else c for c in cols)
    return f"""SELECT {sel}, CreatedDate AS _oc FROM quote_wh
  WHERE CreatedDate >= DATE '{lo}' AND CreatedDate < DATE '{hi_excl}' {where}"""


def quote_order_sql(shape: str) -> str:
    rest = [c for c in R.QUOTE_SHAPES[shape] if c != "QuoteNumber"]
    return ", ".join(["_oc DESC NULLS LAST", "QuoteNumber ASC NULLS FIRST",
                      *[f"{c} ASC NULLS FIRST" for c in rest]])


def _quote_listing_oracle(shape: str, lo: str, hi_excl: str, where: str, skip: int, limit: int) -> str:
    cols = ", ".join(R.QUOTE_SHAPES[shape])
    return f"""
WITH rows AS ({quote_rows_sql(shape, lo, hi_excl, where)}),
pg AS (SELECT * FROM rows ORDER BY {quote_order_sql(shape)} LIMIT {limit} OFFSET {skip})
SELECT {cols}, (SELECT CAST(count(QuoteNumber) AS BIGINT) FROM rows) AS TotalRecords FROM pg
"""


@register("listing_quote", ("quote_wh",), ids="M10 C18 C19 C21 C31 H1 H3 G8 F3",
          oracle=_quote_listing_oracle("quote", "2001-01-15", "2001-06-21", f"AND {FLT}", 50, 100))
def listing_quote(src):
    return R.quote_listing(src["quote_wh"], *WW, AS_OF, COUNTRIES, "all", PETS, skip=50, limit=100)


@register("listing_by_pet_type", ("quote_wh",), ids="M12 C18 C19 H1 H3 G8",
          oracle=_quote_listing_oracle(
              "by_pet_type", "2001-06-05", "2001-06-21",
              "AND (lower(coalesce(PetType, '')) LIKE '%dog%' OR lower(coalesce(PetType, '')) LIKE '%horse%')",
              0, 100))
def listing_by_pet_type(src):
    return R.quote_listing(src["quote_wh"], *MW, AS_OF, pets="dog, Horse", shape="by_pet_type")


@register("listing_conversion", ("quote_wh",), ids="M14 C18 C19 H1 H3 G8",
          oracle=_quote_listing_oracle("conversion", "2001-01-15", "2001-06-21", f"AND {FLT}", 0, 10000))
def listing_conversion(src):
    return R.quote_listing(src["quote_wh"], *WW, AS_OF, COUNTRIES, "all", PETS, skip=0,
                           limit=10000, shape="conversion")


@register("listing_receive_method", ("quote_wh",), ids="M15 K5 K-clamp H1 H3 G8 N24",
          oracle=_quote_listing_oracle("conversion", "2000-12-05", "2001-06-21",
                                       "AND " + _clamp("CreatedDate", 5, 20), 100, 100))
def listing_receive_method(src):
    return R.quote_listing(src["quote_wh"], *MW, AS_OF, skip=100, limit=100, shape="conversion",
                           months=config.METHOD_TREND_MONTHS, clamp_days=True)


SALES_COLS = ["CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteCreatedDate",
              "PolicyNumber", "CreatedDate", "ActualStartDate", "ProductName", "PetType",
              "ClientName", "PetName", "SaleMethod"]


@register("listing_sales", ("sales_wh",), ids="M20 N15 H1 H3 G8", oracle=f"""
WITH rows AS (SELECT {', '.join(SALES_COLS)} FROM sales_wh
              WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
                AND lower(coalesce(PetType, '')) LIKE '%dog%'),
pg AS (SELECT * FROM rows ORDER BY {_order_sql(SALES_COLS)} LIMIT 100 OFFSET 10)
SELECT pg.*, (SELECT CAST(count(PolicyNumber) AS BIGINT) FROM rows) AS TotalRecords FROM pg
""")
def listing_sales(src):
    return R.sales_listing(src["sales_wh"], *MW, pets="dog", skip=10, limit=100)


FREE_COLS = ["CountryCode", "CreatedDate", "QuoteNumber", "PolicyNumber", "SubAgentName",
             "AgentCategoryId", "AgentCategory", "PetType", "ProductName", "StateName",
             "SaleMethod", "PolicyStatusName", "Brand"]


@register("listing_free", ("free_wh",), ids="M19 C22 H1 H3 G8", oracle=f"""
WITH rows AS (SELECT CountryCode, CreatedDate, QuoteNumber, PolicyNumber, SubAgentName, AgentCategoryId,
                     CASE AgentCategoryId WHEN 8 THEN 'Breeder' WHEN 7 THEN 'Pet Business'
                          WHEN 6 THEN 'Charities' WHEN 5 THEN 'Vet' END AS AgentCategory,
                     PetType, ProductName, StateName, SaleMethod, PolicyStatusName, Brand
              FROM free_wh
              WHERE CreatedDate >= DATE '2001-06-05' AND CreatedDate < DATE '2001-06-21'
                AND upper(Brand) IN ('HOUSEHOLD', 'TEST')),
pg AS (SELECT * FROM rows ORDER BY {_order_sql(FREE_COLS)} LIMIT 200 OFFSET 0)
SELECT pg.*, (SELECT CAST(count(PolicyNumber) AS BIGINT) FROM rows) AS TotalRecords FROM pg
""")
def listing_free(src):
    return R.free_listing(src["free_wh"], *MW, brands=["household", "Test", "HOUSEHOLD"], limit=200)


@register("listing_policy", ("crm_wh",), ids="M23 C20 C26 C27 H2 G8 D22 K-clamp", oracle=f"""
WITH rows AS (
  SELECT TIMESTAMP '2001-07-10 12:00:00' AS DateExtracted, Brand,
         coalesce(nullif(Country, ''), CountryCode) AS Country, BusinessName, BusinessType,
         CustomerStatus, FreePolicy, QuoteStatus, QuoteNumber, PolicyNumber, QuoteReceivedMethod,
         QuoteCreatedDate, QuoteStartDate, QuoteEndDate, OriginalPolicyStartDate, PolicyEndDate,
         FirstName, LastName, Email, ContactNo, EmailConcent, PetName, PetType, PetBirthDate,
         PetBreedId, BreedName, CountryCode, PolicyNumber IS NOT NULL AS Converted
  FROM crm_wh
  WHERE QuoteStartDate >= DATE '2001-01-15' AND QuoteStartDate < DATE '2001-06-21'
    AND {_clamp('QuoteStartDate', 15, 20)} AND FreePolicy = 'Yes'),
pg AS (SELECT * FROM rows
       ORDER BY QuoteStartDate ASC NULLS FIRST, PolicyNumber ASC NULLS FIRST, QuoteNumber ASC NULLS FIRST
       LIMIT 100 OFFSET 5)
SELECT pg.*, (SELECT CAST(count(*) AS BIGINT) FROM rows) AS TotalRecords FROM pg
""")
def listing_policy(src):
    return R.policy_listing(src["crm_wh"], *WW, EXTRACTED_AT, date_basis="QuoteStartDate",
                            policy_type="YES", order="asc", skip=5, limit=100)


@register("total_policies", ("crm_wh",), ids="M22", oracle=f"""
SELECT CAST(count(*) AS BIGINT) AS total_policies FROM crm_wh
WHERE OriginalPolicyStartDate >= DATE '2000-08-15' AND OriginalPolicyStartDate < DATE '2001-06-21'
  AND {_clamp('OriginalPolicyStartDate', 15, 20)}
""")
def total_policies(src):
    trend = R.policy_month_trend(src["crm_wh"], *WW, months=11, date_basis="OriginalPolicyStartDate")
    return R.grand_total(trend, "policyCount", "total_policies")


def _pet_breakdown_oracle() -> str:
    return f"SELECT * EXCLUDE (level) FROM ({REGISTRY['breakdown_share'].oracle()}) b WHERE level = 'pet_type'"


@register("breakdown_pet_type", ("free_wh",), ids="M18 L4", oracle_fn=_pet_breakdown_oracle)
def breakdown_pet_type(src):
    """One part of the tagged breakdown."""
    return reshape.split_level(REGISTRY["breakdown_share"].build(src), "pet_type")


@register("listing_deep_page", ("quote_wh",), ids="H1 H3", oracle="""
SELECT QuoteNumber, CountryCode, CreatedDate, PetName FROM quote_wh
ORDER BY CreatedDate DESC NULLS LAST, QuoteNumber NULLS FIRST, CountryCode NULLS FIRST, PetName NULLS FIRST
LIMIT 300 OFFSET 700
""")
def listing_deep_page(src):
    """A page found by refining the key: at most fifty rows before it are sorted."""
    rows = src["quote_wh"].select("QuoteNumber", "CountryCode", "CreatedDate", "PetName")
    order = [paging.desc("CreatedDate"), *paging.asc("QuoteNumber", "CountryCode", "PetName")]
    return paging.page(rows, order, 700, 300, top_rows=50)


@register("listing_equal_keys", ("quote_wh",), ids="H1 H3", oracle="""
SELECT CountryCode, PetType, CreatedDate, QuoteNumber, PetName FROM quote_wh
ORDER BY CountryCode DESC NULLS LAST, PetType NULLS FIRST, CreatedDate DESC NULLS LAST,
         QuoteNumber NULLS FIRST, PetName NULLS FIRST
LIMIT 400 OFFSET 650
""")
def listing_equal_keys(src):
    """A page inside long stretches of equal first and second keys."""
    rows = src["quote_wh"].select("CountryCode", "PetType", "CreatedDate", "QuoteNumber", "PetName")
    order = [paging.desc("CountryCode"), *paging.asc("PetType"), paging.desc("CreatedDate"),
             *paging.asc("QuoteNumber", "PetName")]
    return paging.page(rows, order, 650, 400, top_rows=20)


@register("listing_next_page", ("quote_wh",), ids="H1 H3", oracle="""
SELECT QuoteNumber, CountryCode, CreatedDate, PetName FROM quote_wh
ORDER BY CreatedDate DESC NULLS LAST, QuoteNumber NULLS FIRST, CountryCode NULLS FIRST, PetName NULLS FIRST
LIMIT 250 OFFSET 500
""")
def listing_next_page(src):
    """The second page, begun behind the last row of the first."""
    rows = src["quote_wh"].select("QuoteNumber", "CountryCode", "CreatedDate", "PetName")
    order = [paging.desc("CreatedDate"), *paging.asc("QuoteNumber", "CountryCode", "PetName")]
    last = paging.page(rows, order, 499, 1).first()
    if last is None:
        return rows.limit(0)
    return paging.page_after(rows, order, last.asDict(), 250)

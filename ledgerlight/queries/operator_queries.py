"""Driver queries for single operators (2.C-2.K) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import columns as C
from ledgerlight.functions import filters as D
from ledgerlight.functions import periods as K
from ledgerlight.operators import dedupe, joins, listagg
from ledgerlight.registry import register

WW = config.WIDE_WINDOW
TEST = ["%test%"]
MAILS = config.FIXTURE_DOMAIN.quote_email_patterns


@register("window_scan", ("quote_wh",), ids="A6 D5 D6", oracle="""
SELECT QuoteNumber, CreatedDate, CountryCode FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
""")
def window_scan(src):
    return src["quote_wh"].where(K.in_window("CreatedDate", *WW)).select(
        "QuoteNumber", "CreatedDate", "CountryCode")


@register("quote_date_window", ("quote_src",), ids="D7", oracle="""
SELECT id, quote_date FROM quote_src
WHERE quote_date >= DATE '2001-01-15' AND quote_date < DATE '2001-06-20'
""")
def quote_date_window(src):
    return src["quote_src"].where(K.in_half_open("quote_date", *WW)).select("id", "quote_date")


_EXCL = ("{f} NOT ILIKE '%test%' AND {l} NOT ILIKE '%test%' AND "
         + " AND ".join("{e} NOT ILIKE '" + p + "'" for p in MAILS))


@register("exclude_test_rows_drop_null", ("client_src",), ids="D8 N8 (three-valued)", oracle=f"""
SELECT id, first_name, last_name, email FROM client_src
WHERE {_EXCL.format(f='first_name', l='last_name', e='email')}
""")
def exclude_test_rows_drop_null(src):
    spec = {"first_name": TEST, "last_name": TEST, "email": MAILS}
    return src["client_src"].where(D.exclude_like(spec, keep_null=False)).select(
        "id", "first_name", "last_name", "email")


@register("exclude_test_rows_keep_null", ("client_src",), ids="D8 N8 (ISNULL form)", oracle=f"""
SELECT id, first_name, last_name, email FROM client_src
WHERE {_EXCL.format(f="coalesce(first_name, '')", l="coalesce(last_name, '')", e="coalesce(email, '')")}
""")
def exclude_test_rows_keep_null(src):
    spec = {"first_name": TEST, "last_name": TEST, "email": MAILS}
    return src["client_src"].where(D.exclude_like(spec, keep_null=True)).select(
        "id", "first_name", "last_name", "email")


@register("shared_filters", ("quote_wh",), ids="D1 D2 D3 D4 N3 N4", oracle="""
SELECT QuoteNumber, CountryCode, Brand, PetType FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
  AND upper(CountryCode) = 'ASIA'
  AND upper(Brand) IN ('BUILDING', 'MACHINERY')
  AND (lower(coalesce(PetType, '')) LIKE '%horse%' OR lower(coalesce(PetType, '')) LIKE '%bb_com%')
""")
def shared_filters(src):
    flt = D.report_filters(" asia ", "building, Machinery,BUILDING", ["HORSE", "bbcom", "bbc"])
    return src["quote_wh"].where(K.in_window("CreatedDate", *WW) & flt).select(
        "QuoteNumber", "CountryCode", "Brand", "PetType")


@register("unknown_token_filter", ("quote_wh",), ids="D3 D4 N6", oracle="""
SELECT QuoteNumber, PetType FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21'
""")
def unknown_token_filter(src):
    flt = D.report_filters("all", "Brand1,ALL", "parrot, snake")
    return src["quote_wh"].where(K.in_window("CreatedDate", *WW) & flt).select("QuoteNumber", "PetType")


@register("list_lookup", ("answer_src", "list_src", "question_dim"), ids="C28 J22 F9", oracle="""
WITH tok AS (SELECT DISTINCT quote_id, TRY_CAST(trim(t) AS INTEGER) AS tid
             FROM (SELECT a.quote_id, unnest(string_split(l.answer, ',')) AS t
                   FROM answer_src a JOIN list_src l ON l.answer_id = a.id WHERE a.question_id = 502) s)
SELECT tok.quote_id, string_agg(d.question_detail_name, ', ' ORDER BY d.question_detail_name) AS names
FROM tok JOIN question_dim d ON d.id = tok.tid
GROUP BY tok.quote_id
""")
def list_lookup(src):
    asked = src["answer_src"].where(F.col("question_id") == config.FIXTURE_DOMAIN.activity_question)
    answers = src["list_src"].join(asked.select(F.col("id").alias("answer_id"), "quote_id"), "answer_id")
    return listagg.lookup_list(answers, "quote_id", "answer", src["question_dim"], "id",
                               "question_detail_name")


@register("late_cancellation", ("policy_src", "cancel_src"), ids="J9 D13", oracle="""
SELECT p.id, p.created_date, pc.created_date AS cancelled_date
FROM policy_src p LEFT JOIN cancel_src pc ON pc.policy_id = p.id
WHERE pc.id IS NULL OR pc.created_date >= p.created_date + INTERVAL 1 DAY
""")
def late_cancellation(src):
    pc = src["cancel_src"].select(F.col("id").alias("pc_id"), F.col("policy_id").alias("pc_policy"),
                                  F.col("created_date").alias("cancelled_date"))
    p = src["policy_src"]
    return (joins.fanout_left_join(p, pc, "id", "pc_policy")
             .where(D.late_cancellation_keep("pc_id", "cancelled_date", "created_date"))
             .select("id", "created_date", "cancelled_date"))


@register("existence_priority_rank", ("quote_src", "policy_src"), ids="J21 G5", oracle="""
WITH r AS (
  SELECT q.id, q.first_name, q.last_name, q.pet_name,
         row_number() OVER (PARTITION BY q.first_name, q.last_name, q.pet_name
           ORDER BY CASE WHEN EXISTS (SELECT 1 FROM policy_src pa WHERE pa.quote_id = q.id) THEN 0 ELSE 1 END,
                    q.quote_date DESC NULLS LAST,
                    CASE WHEN coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0), nullif(q.breed_id3, 0))
                         IS NOT NULL THEN 0 ELSE 1 END,
                    q.id) AS rn
  FROM quote_src q)
SELECT id, first_name, last_name, pet_name FROM r WHERE rn = 1
""")
def existence_priority_rank(src):
    q = src["quote_src"]
    flagged = dedupe.existence_flag(q, "id", src["policy_src"], "quote_id", flag="_has_policy")
    breed = C.first_nonzero("breed_id1", "breed_id2", "breed_id3")
    return dedupe.latest_per_key(
        flagged, ["first_name", "last_name", "pet_name"],
        [F.col("_has_policy").desc(), F.col("quote_date").desc(), breed.isNull().asc(), F.col("id").asc()]
    ).select("id", "first_name", "last_name", "pet_name")


@register("semi_join_latest_policy", ("quote_src", "policy_src"), ids="J24 J25 J26 G5 G6", oracle="""
WITH ranked AS (
  SELECT q.id, row_number() OVER (PARTITION BY q.first_name, q.last_name, q.pet_name
           ORDER BY CASE WHEN EXISTS (SELECT 1 FROM policy_src pa WHERE pa.quote_id = q.id) THEN 0 ELSE 1 END,
                    q.quote_date DESC NULLS LAST,
                    CASE WHEN coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0), nullif(q.breed_id3, 0))
                         IS NOT NULL THEN 0 ELSE 1 END,
                    q.id) AS rn
  FROM quote_src q),
picked AS (SELECT id FROM ranked WHERE rn = 1),
lp AS (SELECT pa.quote_id, pa.policy_number, pa.created_date,
              row_number() OVER (PARTITION BY pa.quote_id
                                 ORDER BY pa.created_date DESC NULLS LAST, pa.policy_number) AS rn
       FROM policy_src pa JOIN policy_src p ON p.policy_number = pa.policy_number
       WHERE pa.quote_id IN (SELECT id FROM picked))
SELECT picked.id AS quote_id, lp.policy_number, lp.created_date
FROM picked LEFT JOIN lp ON lp.quote_id = picked.id AND lp.rn = 1
""")
def semi_join_latest_policy(src):
    picked = existence_priority_rank(src).select(F.col("id").alias("quote_id"))
    pa = src["policy_src"].select("quote_id", "policy_number", "created_date")
    pol = src["policy_src"].select(F.col("policy_number").alias("p_number"))
    lp = (pa.join(picked, "quote_id", "left_semi")
            .join(pol, F.col("p_number") == F.col("policy_number"), "inner"))
    lp = dedupe.latest_per_key(lp, ["quote_id"], [F.col("created_date").desc(), F.col("policy_number").asc()])
    return picked.join(lp.select("quote_id", "policy_number", "created_date"), "quote_id", "left")


@register("dedupe_normalised", ("quote_src", "product_dim"), ids="G1 D15", oracle="""
WITH r AS (SELECT q.id, q.created_date, q.email, q.pet_name, p.pet_type_id,
                  row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), lower(trim(q.email)), p.pet_type_id,
                                                  lower(trim(q.pet_name)) ORDER BY q.id DESC) AS rn
           FROM quote_src q JOIN product_dim p ON p.id = q.product_id)
SELECT id, created_date, email, pet_type_id, pet_name FROM r WHERE rn = 1
""")
def dedupe_normalised(src):
    product = src["product_dim"].select(F.col("id").alias("product_id"), "pet_type_id")
    q = src["quote_src"].join(product, "product_id")
    return dedupe.latest_per_key(
        q, [F.to_date("created_date"), dedupe.normalised_key("email"), F.col("pet_type_id"),
            dedupe.normalised_key("pet_name")],
        [F.col("id").desc()]).select("id", "created_date", "email", "pet_type_id", "pet_name")


def _clamp_oracle(s: int, e: int, lo: str, hi: str) -> str:
    eom = "day(last_day(CreatedDate))"
    return f"""
SELECT strftime(CreatedDate, '%Y-%m') AS period, count(*) AS value
FROM quote_wh
WHERE CreatedDate >= DATE '{lo}' AND CreatedDate < DATE '{hi}'
  AND day(CreatedDate) >= least({s}, {eom}) AND day(CreatedDate) <= least({e}, {eom})
GROUP BY 1
"""


@register("clamp_window_31_31", ("quote_wh",), ids="K-clamp (month ends)",
          oracle=_clamp_oracle(31, 31, "1994-01-01", "2003-01-01"))
def clamp_window_31_31(src):
    return (src["quote_wh"].where(K.in_window("CreatedDate", *config.FULL_WINDOW)
                                  & K.day_window_clamp("CreatedDate", 31, 31))
            .groupBy(K.period_key("CreatedDate").alias("period")).agg(F.count(F.lit(1)).alias("value")))


@register("wrap_window_20_10", ("quote_wh",), ids="K-wrap (start day > end day)", oracle="""
SELECT strftime(CreatedDate, '%Y-%m') AS period, count(*) AS value
FROM quote_wh
WHERE CreatedDate >= DATE '1994-01-01' AND CreatedDate < DATE '2003-01-01'
  AND (day(CreatedDate) >= 20 OR day(CreatedDate) <= 10)
GROUP BY 1
""")
def wrap_window_20_10(src):
    return (src["quote_wh"].where(K.in_window("CreatedDate", *config.FULL_WINDOW)
                                  & K.day_window_wrap("CreatedDate", 20, 10))
            .groupBy(K.period_key("CreatedDate").alias("period")).agg(F.count(F.lit(1)).alias("value")))


@register("pattern_buckets", ("product_dim",), ids="C11 C12 C13 C14", oracle="""
SELECT id, product_code,
  CASE WHEN product_code ILIKE '%CAT%' THEN 'Cat' WHEN product_code ILIKE '%DOG%' THEN 'Dog'
       WHEN product_code ILIKE '%EQUINE%' THEN 'Horse' WHEN product_code ILIKE '%HORSE%' THEN 'Horse'
       WHEN product_code ILIKE '%EXOTIC%' THEN 'Exotic' WHEN product_code ILIKE '%PROF%' THEN 'Professional'
       ELSE 'OTHER' END AS sales_type,
  CASE WHEN lower(coalesce(product_code, '')) LIKE '%cat%' THEN 'Cat'
       WHEN lower(coalesce(product_code, '')) LIKE '%dog%' THEN 'Dog'
       WHEN lower(coalesce(product_code, '')) LIKE '%horse%' THEN 'Horse'
       WHEN lower(coalesce(product_code, '')) LIKE '%exotic%' THEN 'Exotic'
       WHEN lower(coalesce(product_code, '')) LIKE '%bb_com%' THEN 'BB' ELSE 'Others' END AS free_type,
  CASE WHEN product_code ILIKE '%dog%' THEN 'Dog' WHEN product_code ILIKE '%cat%' THEN 'Cat'
       WHEN product_code ILIKE '%exotic%' THEN 'Exotic' WHEN product_code ILIKE '%horse%' THEN 'Horse'
       ELSE product_code END AS crm_type
FROM product_dim
""")
def pattern_buckets(src):
    p = src["product_dim"]
    return p.select(
        "id", "product_code",
        C.bucket("product_code", config.SALES_CODE_BUCKETS, config.SALES_CODE_DEFAULT,
                 lower=False, null_as_empty=False).alias("sales_type"),
        C.bucket("product_code", config.FREE_CODE_BUCKETS, config.FREE_CODE_DEFAULT).alias("free_type"),
        C.bucket("product_code", config.CRM_CODE_BUCKETS, F.col("product_code"), lower=False,
                 null_as_empty=False).alias("crm_type"))


@register("contact_fallback", ("quote_src", "client_src"), ids="C1 C2 C3 C4 C29 J3 N7", oracle="""
SELECT q.id,
       coalesce(q.first_name, c.first_name) || ' ' || coalesce(q.last_name, c.last_name) AS full_name,
       concat(coalesce(coalesce(q.address1, c.address1), ''), ', ',
              coalesce(coalesce(q.address2, c.address2), '')) AS address,
       coalesce(q.mobile, q.primary_contact_number, c.primary_contact_number,
                c.alternative_contact_number) AS contact_no,
       coalesce(CAST(q.is_pet_id_product AS INT), 0) AS is_pet_id
FROM quote_src q LEFT JOIN client_src c ON c.id = q.client_id
""")
def contact_fallback(src):
    q, c = src["quote_src"].alias("q"), src["client_src"].alias("c")
    j = q.join(c, F.col("q.client_id") == F.col("c.id"), "left")
    return j.select(
        F.col("q.id").alias("id"),
        C.full_name(C.fallback("q.first_name", "c.first_name"), C.fallback("q.last_name", "c.last_name")
                    ).alias("full_name"),
        C.address(C.fallback("q.address1", "c.address1"), C.fallback("q.address2", "c.address2")
                  ).alias("address"),
        C.first_non_null("q.mobile", "q.primary_contact_number", "c.primary_contact_number",
                         "c.alternative_contact_number").alias("contact_no"),
        C.default_flag("q.is_pet_id_product").alias("is_pet_id"))


@register("channel_and_type", ("quote_src", "user_dim"), ids="C6 C7 C8 J14", oracle="""
SELECT q.id,
       CASE WHEN q.quote_save_from = 1 THEN 'NB' WHEN q.quote_save_from = 2 THEN 'NB'
            WHEN q.quote_save_from = 0 THEN 'Endorsement, Amendment' ELSE 'Renew' END AS transaction_type,
       CASE WHEN q.quote_save_from = 2 THEN 'Web' ELSE 'Phone' END AS received_method,
       CASE WHEN u.first_name IN ('FIT', 'Web') THEN 'Web' ELSE 'Phone' END AS sale_method
FROM quote_src q LEFT JOIN user_dim u ON u.id = q.executive_id
""")
def channel_and_type(src):
    u = src["user_dim"].select(F.col("id").alias("u_id"), F.col("first_name").alias("u_first"))
    return (src["quote_src"].join(u, F.col("u_id") == F.col("executive_id"), "left")
            .select("id", C.transaction_type("quote_save_from").alias("transaction_type"),
                    C.received_method("quote_save_from").alias("received_method"),
                    C.sale_method("u_first").alias("sale_method")))


@register("quote_status_flags", ("quote_wh",), ids="C18 C19 C20 C21 D16", oracle="""
SELECT QuoteNumber, CreatedDate,
       CASE WHEN coalesce(QuoteExpiryDate, QuoteStartDate) IS NULL THEN NULL
            WHEN DATE '2001-07-10' > QuoteExpiryDate THEN 'Lapsed' ELSE 'Live' END AS QuoteStatus,
       CASE WHEN PolicyNumber IS NULL OR PolicyNumber ILIKE '%none%' THEN 'No' ELSE 'Yes' END AS ConvertedQuote,
       PolicyNumber IS NOT NULL AS Converted,
       CASE WHEN (nullif(trim(FullName), '') IS NULL OR nullif(trim(Email), '') IS NULL
                  OR nullif(trim(Address), '') IS NULL OR nullif(trim(PostCode), '') IS NULL
                  OR nullif(trim(ContactNo), '') IS NULL OR nullif(trim(PetType), '') IS NULL
                  OR nullif(trim(PetName), '') IS NULL) THEN 'No' ELSE 'Yes' END AS QuoteDetailsCompleted
FROM quote_wh
""")
def quote_status_flags(src):
    return src["quote_wh"].select(
        "QuoteNumber", "CreatedDate",
        C.quote_status("QuoteExpiryDate", "QuoteStartDate", config.AS_OF).alias("QuoteStatus"),
        C.converted_quote("PolicyNumber").alias("ConvertedQuote"),
        C.converted_flag("PolicyNumber").alias("Converted"),
        C.details_completed().alias("QuoteDetailsCompleted"))


@register("customer_status_flags", ("crm_wh",), ids="C22 C25 C26", oracle="""
SELECT QuoteNumber,
       CASE WHEN PolicyNumber IS NULL THEN 'Quote'
            WHEN DATE '2001-07-10' < PolicyEndDate THEN
                 CASE WHEN CustomerStatus IN ('Active', 'Converted') THEN 'Active' ELSE CustomerStatus END
            ELSE 'Expired' END AS customer_status,
       CASE PetBreedId WHEN 8 THEN 'Breeder' WHEN 7 THEN 'Pet Business' WHEN 6 THEN 'Charities'
                       WHEN 5 THEN 'Vet' END AS agent_category,
       coalesce(nullif(Country, ''), CountryCode) AS country
FROM crm_wh
""")
def customer_status_flags(src):
    crm = src["crm_wh"]
    return crm.select(
        "QuoteNumber",
        C.customer_status("PolicyNumber", "PolicyEndDate", "CustomerStatus", config.AS_OF
                          ).alias("customer_status"),
        C.agent_category("PetBreedId").alias("agent_category"),
        C.country("Country", "CountryCode").alias("country"))


@register("clean_dates", ("quote_wh",), ids="K11 N17", oracle="""
WITH t AS (SELECT QuoteNumber,
                  CASE WHEN QuoteNumber IS NULL THEN NULL
                       WHEN right(QuoteNumber, 1) = '7' THEN 'garbage'
                       WHEN right(QuoteNumber, 1) = '3' THEN '1752-12-31'
                       WHEN right(QuoteNumber, 1) = '5' THEN '1753-01-01'
                       ELSE strftime(CreatedDate, '%Y-%m-%d %H:%M:%S') END AS raw
           FROM quote_wh)
SELECT QuoteNumber, raw,
       CASE WHEN TRY_CAST(raw AS TIMESTAMP) >= TIMESTAMP '1753-01-01 00:00:00'
            THEN TRY_CAST(raw AS TIMESTAMP) END AS cleaned
FROM t
""")
def clean_dates(src):
    q = src["quote_wh"]
    last = F.substring("QuoteNumber", -1, 1)
    raw = (F.when(F.col("QuoteNumber").isNull(), F.lit(None).cast("string"))
            .when(last == "7", F.lit("garbage"))
            .when(last == "3", F.lit("1752-12-31"))
            .when(last == "5", F.lit("1753-01-01"))
            .otherwise(F.date_format("CreatedDate", "yyyy-MM-dd HH:mm:ss")))
    t = q.select("QuoteNumber", raw.alias("raw"))
    return t.select("QuoteNumber", "raw", K.clean_date("raw").cast("timestamp_ntz").alias("cleaned"))


@register("report_order", ("free_wh",), ids="H4 (values checked here; order checked in pytest)", oracle="""
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
ORDER BY level, value DESC, name NULLS FIRST
""")
def report_order(src):
    from ledgerlight.plans import reports as R
    return R.free_policy_breakdown(src["free_wh"], *WW).orderBy(
        F.col("level").asc(), F.col("value").desc(), F.col("name").asc_nulls_first())


@register("fanout_chain", ("quote_src", "client_src", "policy_src", "policy_full_src"),
          ids="J3 J4 J5 C30", oracle="""
SELECT q.id AS quote_id, c.country_code, pa.policy_number, pp.actual_start_date
FROM quote_src q
LEFT JOIN client_src c ON c.id = q.client_id
LEFT JOIN policy_src pa ON pa.quote_id = q.id
LEFT JOIN policy_full_src pp ON pp.id = pa.id
""")
def fanout_chain(src):
    q = src["quote_src"].select(F.col("id").alias("quote_id"), "client_id")
    c = src["client_src"].select(F.col("id").alias("c_id"), "country_code")
    pa = src["policy_src"].select(F.col("quote_id").alias("pa_quote"), F.col("id").alias("pa_id"),
                                  "policy_number")
    pp = src["policy_full_src"].select(F.col("id").alias("pp_id"), "actual_start_date")
    return (joins.fanout_left_join(q.join(c, F.col("c_id") == F.col("client_id"), "left"),
                                   pa, "quote_id", "pa_quote")
             .join(pp, F.col("pp_id") == F.col("pa_id"), "left")
             .select("quote_id", "country_code", "policy_number", "actual_start_date"))


@register("conditional_exclusion", ("quote_src", "hear_about_dim"), ids="D12 J7 N9", oracle="""
SELECT q.id, q.product_id, h.name
FROM quote_src q LEFT JOIN hear_about_dim h ON h.id = q.hear_about_us
WHERE q.product_id <> 40 OR (q.product_id = 40 AND h.name NOT IN ('ASIA', 'EUROPE'))
""")
def conditional_exclusion(src):
    dom = config.FIXTURE_DOMAIN
    h = src["hear_about_dim"]
    return (src["quote_src"].join(h.select(F.col("id").alias("h_id"), "name"),
                                  F.col("h_id") == F.col("hear_about_us"), "left")
            .where(D.product_exclusion("product_id", dom.bb_product, "name", dom.excluded_hear_about))
            .select("id", "product_id", "name"))


@register("union_all_branches", ("quote_src",), ids="I1 I2 F13 N23", oracle="""
SELECT id, 'a' AS branch FROM quote_src WHERE product_id IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13,
  14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40)
UNION ALL
SELECT id, 'b' AS branch FROM quote_src WHERE product_id BETWEEN 100 AND 119
""")
def union_all_branches(src):
    dom = config.FIXTURE_DOMAIN
    q = src["quote_src"]
    a = q.where(F.col("product_id").isin(dom.branch_a_products)).select("id", F.lit("a").alias("branch"))
    b = q.where(F.col("product_id").isin(dom.branch_b_products)).select("id", F.lit("b").alias("branch"))
    return a.unionByName(b)


@register("first_nonzero_join", ("quote_src", "breed_dim"), ids="C5 J6", oracle="""
SELECT q.id, CAST(coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0), nullif(q.breed_id3, 0))
                 AS VARCHAR) AS breed_id,
       b.breed_name
FROM quote_src q
LEFT JOIN breed_dim b ON b.id = coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0), nullif(q.breed_id3, 0))
""")
def first_nonzero_join(src):
    key = C.first_nonzero("breed_id1", "breed_id2", "breed_id3")
    b = src["breed_dim"].select(F.col("id").alias("b_id"), "breed_name")
    q = src["quote_src"].withColumn("breed_id", key)
    # breed_id is a nullable INT: compared as text (engine-neutral pandas dtype).
    return q.join(b, F.col("b_id") == F.col("breed_id"), "left").select(
        "id", F.col("breed_id").cast("string").alias("breed_id"), "breed_name")


@register("product_class_join", ("quote_src", "pet_type_dim"), ids="C9 C10 J8 D11", oracle="""
SELECT q.id, q.product_id,
       CASE WHEN q.product_id = 40 THEN 'BB_Commercial' ELSE pty.pet_type_name END AS pet_type
FROM quote_src q
LEFT JOIN pet_type_dim pty ON pty.pet_type_id =
  CASE WHEN q.product_id IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 3
       WHEN q.product_id IN (10, 11, 12, 13, 14, 15, 16, 17, 18, 19) THEN 4
       WHEN q.product_id IN (20, 21, 22, 23, 24, 25, 26, 27, 28, 29) THEN 6
       WHEN q.product_id IN (30, 31, 32, 33, 34, 35, 36, 37, 38, 39) THEN 7 END
WHERE q.product_id BETWEEN 0 AND 40
""")
def product_class_join(src):
    dom = config.FIXTURE_DOMAIN
    pty = src["pet_type_dim"]
    q = src["quote_src"].where(F.col("product_id").isin(dom.branch_a_products))
    return (q.join(pty, pty["pet_type_id"] == C.product_class("product_id", dom.class_products), "left")
             .select("id", "product_id",
                     C.bb_pet_type("product_id", dom.bb_product, "pet_type_name").alias("pet_type")))


@register("class_join_filtered", ("quote_src", "product_dim", "pet_type_dim"), ids="J1 J2 D14", oracle="""
SELECT q.id, p.product_name, pty.pet_type_name
FROM quote_src q
JOIN product_dim p ON p.id = q.product_id AND p.parent_product_id IS NOT NULL
                  AND p.product_name NOT ILIKE '%INTRODUCTORY%'
LEFT JOIN pet_type_dim pty ON pty.pet_type_id = p.pet_type_id
""")
def class_join_filtered(src):
    p = src["product_dim"].where(F.col("parent_product_id").isNotNull()
                                 & ~F.col("product_name").ilike("%INTRODUCTORY%"))
    pty = src["pet_type_dim"]
    q = src["quote_src"]
    return (q.join(p.select(F.col("id").alias("p_id"), "product_name", F.col("pet_type_id").alias("p_type")),
                   F.col("p_id") == F.col("product_id"), "inner")
             .join(pty, pty["pet_type_id"] == F.col("p_type"), "left")
             .select("id", "product_name", "pet_type_name"))


@register("brand_rules", ("quote_wh",), ids="C15 C16", oracle="""
SELECT QuoteNumber,
       CASE WHEN PetType = 'BB_Commercial' THEN 'BB'
            WHEN length(coalesce(PolicyNumber, '')) % 3 = 0 THEN 'BPIS'
            WHEN length(coalesce(PolicyNumber, '')) % 3 = 1 THEN 'PetId' ELSE 'Unknown' END AS quote_brand,
       CASE WHEN length(coalesce(PolicyNumber, '')) % 3 = 1 THEN 'PetId'
            WHEN PetType ILIKE '%BB_COM%' THEN 'BB' ELSE 'BPIS' END AS sales_brand
FROM quote_wh
""")
def brand_rules(src):
    q = src["quote_wh"]
    flag = F.length(F.coalesce(F.col("PolicyNumber"), F.lit(""))) % 3
    return q.select("QuoteNumber", C.brand_quote_uk("PetType", flag).alias("quote_brand"),
                    C.brand_sales_uk("PetType", flag).alias("sales_brand"))


@register("dedupe_raw", ("quote_src", "pet_type_dim"), ids="G2 G3 D15 (raw keys)", oracle="""
WITH r AS (
  SELECT q.id, q.created_date, q.email, q.pet_name, pty.pet_type_name,
         row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), q.email, pty.pet_type_name, q.pet_name
                            ORDER BY q.id DESC) AS rn
  FROM quote_src q
  LEFT JOIN pet_type_dim pty ON pty.pet_type_id =
    CASE WHEN q.product_id IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 3
         WHEN q.product_id IN (10, 11, 12, 13, 14, 15, 16, 17, 18, 19) THEN 4
         WHEN q.product_id IN (20, 21, 22, 23, 24, 25, 26, 27, 28, 29) THEN 6
         WHEN q.product_id IN (30, 31, 32, 33, 34, 35, 36, 37, 38, 39) THEN 7 END)
SELECT id, created_date, email, pet_name, pet_type_name FROM r WHERE rn = 1
""")
def dedupe_raw(src):
    """Newest quote per day x raw mail x pet type x raw pet name (no
    trimming or lower-casing, unlike G1)."""
    dom = config.FIXTURE_DOMAIN
    pty = src["pet_type_dim"]
    q = src["quote_src"].join(pty, pty["pet_type_id"] == C.product_class("product_id", dom.class_products),
                              "left")
    return dedupe.latest_per_key(
        q, [F.to_date("created_date"), "email", "pet_type_name", "pet_name"], [F.col("id").desc()]
    ).select("id", "created_date", "email", "pet_name", "pet_type_name")


@register("final_dedupe", ("crm_wh",), ids="G7 N7 (computed key)", oracle="""
WITH r AS (
  SELECT QuoteNumber, PolicyNumber, FirstName, LastName, PetName, QuoteCreatedDate, OriginalPolicyStartDate,
         row_number() OVER (
           PARTITION BY CASE WHEN PolicyNumber IS NOT NULL THEN PolicyNumber
                             ELSE concat(coalesce(FirstName, ''), '|', coalesce(LastName, ''), '|',
                                         coalesce(PetName, '')) END
           ORDER BY CASE WHEN PolicyNumber IS NOT NULL THEN OriginalPolicyStartDate END DESC NULLS LAST,
                    QuoteCreatedDate DESC NULLS LAST, QuoteNumber ASC NULLS FIRST) AS rn
  FROM crm_wh)
SELECT QuoteNumber, PolicyNumber, FirstName, LastName, PetName, QuoteCreatedDate, OriginalPolicyStartDate
FROM r WHERE rn = 1
""")
def final_dedupe(src):
    """G7 on the CRM table: one row per policy, else per person|pet."""
    crm = src["crm_wh"]
    has_pol = F.col("PolicyNumber").isNotNull()
    key = F.when(has_pol, F.col("PolicyNumber")).otherwise(
        C.concat_null_as_empty("FirstName", F.lit("|"), "LastName", F.lit("|"), "PetName"))
    return dedupe.latest_per_key(
        crm, [key], [F.when(has_pol, F.col("OriginalPolicyStartDate")).desc(),
                     F.col("QuoteCreatedDate").desc(), F.col("QuoteNumber").asc()]
    ).select("QuoteNumber", "PolicyNumber", "FirstName", "LastName", "PetName", "QuoteCreatedDate",
             "OriginalPolicyStartDate")


@register("bound_param_read", ("quote_wh",), ids="A6 D5 (named parameter markers)", oracle="""
SELECT QuoteNumber, CreatedDate, Brand FROM quote_wh
WHERE CreatedDate >= DATE '2001-01-15' AND CreatedDate < DATE '2001-06-21' AND upper(Brand) = 'BUILDING'
""")
def bound_param_read(src):
    from ledgerlight.functions import periods as K2
    from ledgerlight.sources.registry import read_bound
    w = K2.parse_dates(*WW)
    return read_bound(
        src.spark,
        "SELECT QuoteNumber, CreatedDate, Brand FROM {quote} "
        "WHERE CreatedDate >= :start AND CreatedDate < :end_excl AND upper(Brand) = :brand",
        {"start": w.start, "end_excl": w.end_exclusive, "brand": "BUILDING"},
        quote=src["quote_wh"])



# ---- keys under a collation ---------------------------------------------------

# Quotes whose mails and names are spelt in several ways.
SPELT = """SELECT id, created_date,
       CASE id % 3 WHEN 0 THEN upper(email) WHEN 1 THEN concat(email, '  ') ELSE email END AS email,
       CASE WHEN id % 2 = 0 THEN lower(pet_name) ELSE pet_name END AS pet_name FROM {quotes}"""


def _spelt_oracle(key: str) -> str:
    def k(c):
        return key.format(c=c)
    return f"""
WITH s AS ({SPELT.format(quotes="quote_src")}),
r AS (SELECT *, row_number() OVER (PARTITION BY {k('email')}, {k('pet_name')} ORDER BY id DESC) AS rn FROM s)
SELECT id, created_date, email, pet_name FROM r WHERE rn = 1
"""


def _spelt(src, collation):
    rows = src.spark.sql(SPELT.replace("{quotes}", "{q}"), q=src["quote_src"])
    return dedupe.latest_per_key(rows, ["email", "pet_name"], [F.col("id").desc()], collation=collation)


@register("dedupe_by_bytes", ("quote_src",), ids="G2 G3 G4 N13 (keys by bytes)", oracle_fn=lambda: _spelt_oracle("{c}"))
def dedupe_by_bytes(src):
    return _spelt(src, None)


@register("dedupe_collated", ("quote_src",), ids="G2 G3 G4 G7 N3 N13 (keys without case and trailing blanks)",
          oracle_fn=lambda: _spelt_oracle("lower(rtrim({c}))"))
def dedupe_collated(src):
    return _spelt(src, config.NOCASE_KEYS)


@register("policy_join_collated", ("policy_src",), ids="J24 N3", oracle="""
SELECT a.id, a.number_a, b.number_b
FROM (SELECT id, lower(policy_number) AS number_a FROM policy_src) a
JOIN (SELECT id AS id_b, concat(policy_number, '   ') AS number_b FROM policy_src WHERE id % 2 = 0) b
  ON lower(rtrim(a.number_a)) = lower(rtrim(b.number_b))
""")
def policy_join_collated(src):
    """Policy numbers joined whatever their case and trailing blanks."""
    p = src["policy_src"]
    a = p.select("id", F.lower("policy_number").alias("number_a"))
    b = p.where("id % 2 = 0").select(F.concat("policy_number", F.lit("   ")).alias("number_b"))
    same = dedupe.collated("number_a", config.NOCASE_KEYS) == dedupe.collated("number_b", config.NOCASE_KEYS)
    return a.join(b, same).select("id", "number_a", "number_b")

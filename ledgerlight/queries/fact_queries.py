"""Driver queries for the fact builders (M1-M7) with DuckDB oracles.

The facts run over the whole fixture range (``config.FULL_WINDOW``), so their
work grows with the tables.  Fixture domain constants (``FIXTURE_DOMAIN``):
branch A products 0..39 by class plus BB product 40, branch B 100..119,
excluded hear-about names ASIA/EUROPE, active statuses AFRICA/AMERICA.
"""

from __future__ import annotations

from ledgerlight import config
from ledgerlight.plans import facts
from ledgerlight.registry import register

FW = config.FULL_WINDOW
LO, HI = "1994-01-01", "2003-01-01"
DOM = config.FIXTURE_DOMAIN


def _ids(xs) -> str:
    return ", ".join(str(x) for x in xs)


BRANCH_A = _ids(DOM.branch_a_products)
BRANCH_B = _ids(DOM.branch_b_products)
CLASS_CASE = "CASE " + " ".join(
    f"WHEN {{p}} IN ({_ids(ids)}) THEN {t}" for t, ids in DOM.class_products.items()) + " END"
SALES_CLASS_CASE = "CASE " + " ".join(
    f"WHEN {{p}} IN ({_ids(ids)}) THEN {t}" for t, ids in DOM.sales_class_products.items()) + " END"
SALES_ALL = _ids([p for ids in DOM.sales_class_products.values() for p in ids] + [DOM.bb_product])
BB = DOM.bb_product
HEAR_EXCL = "('ASIA', 'EUROPE')"

QUOTE_OUT = ", ".join(facts.QUOTE_FACT_COLUMNS)
BRAND = f"'{DOM.brand_constant}'"


def not_ilike(col: str, patterns) -> str:
    """``col NOT ILIKE p AND ...`` for the given patterns."""
    return " AND ".join(f"{col} NOT ILIKE '{p}'" for p in patterns)


MAIL_Q_NULLSAFE = not_ilike("coalesce(email, '')", DOM.quote_email_patterns)
MAIL_Q = not_ilike("email", DOM.quote_email_patterns)
MAIL_C = not_ilike("c.email", DOM.quote_email_patterns)

QUOTE_COMMON_COLS = """
     pp.created_date AS PolicyCreatedDate, q.quote_number AS QuoteNumber,
     q.created_date AS CreatedDate, q.quote_date AS QuoteStartDate, q.expire_date AS QuoteExpiryDate,
     CASE WHEN q.quote_save_from = 2 THEN 'Web' ELSE 'Phone' END AS QuoteReceivedMethod,
     pa.policy_number AS PolicyNumber, pp.actual_start_date AS PolicyStartDate,
     pp.actual_end_date AS PolicyEndDate,
     coalesce(q.first_name, c.first_name) || ' ' || coalesce(q.last_name, c.last_name) AS FullName,
     q.email AS Email,
     concat(coalesce(coalesce(q.address1, c.address1), ''), ', ',
            coalesce(coalesce(q.address2, c.address2), '')) AS Address,
     coalesce(q.suburb, c.suburb) AS Suburb, coalesce(q.post_code, c.post_code) AS PostCode,
     coalesce(q.mobile, q.primary_contact_number, c.primary_contact_number,
              c.alternative_contact_number) AS ContactNo,
     q.pet_name AS PetName, q.pet_birth_date AS PetBirthDate, b.breed_name AS BreedName"""

POLICY_BREED_JOINS = """
  LEFT JOIN policy_src pa ON pa.quote_id = q.id
  LEFT JOIN policy_full_src pp ON pp.id = pa.id
  LEFT JOIN breed_dim b ON b.id = coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0),
                                           nullif(q.breed_id3, 0))"""

RANK_ORDER = "q.id DESC, pp.created_date DESC NULLS LAST, pa.policy_number ASC NULLS FIRST"


@register("fact_quote_a", ("quote_src", "client_src", "policy_src", "policy_full_src", "product_dim",
                           "pet_type_dim", "breed_dim"),
          ids="M1 J1 J2 J3 J4 J5 J6 C1-C7 C17 D6 D8 D9 D10 D14 G1 D15", oracle=f"""
WITH q AS (SELECT * FROM quote_src
           WHERE created_date >= DATE '{LO}' AND created_date < DATE '{HI}'
             AND created_by IS NOT NULL AND quote_save_from IS NOT NULL AND quote_parent_id IS NULL
             AND NOT (coalesce(CAST(is_pet_id_product AS INT), 0) = 1) AND migrated_quote_id IS NULL
             AND coalesce(first_name, '') NOT ILIKE '%test%' AND coalesce(last_name, '') NOT ILIKE '%test%'
             AND {MAIL_Q_NULLSAFE}
             AND coalesce(pet_name, '') NOT ILIKE '%test%'),
j AS (
  SELECT {BRAND} AS Brand, {QUOTE_COMMON_COLS}, pty.pet_type_name AS PetType,
     row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), lower(trim(q.email)),
                                     pty.pet_type_name, lower(trim(q.pet_name))
                        ORDER BY {RANK_ORDER}) AS rn
  FROM q
  JOIN product_dim p ON p.id = q.product_id AND p.parent_product_id IS NOT NULL
                    AND p.product_name NOT ILIKE '%INTRODUCTORY%'
  LEFT JOIN pet_type_dim pty ON pty.pet_type_id = p.pet_type_id
  LEFT JOIN client_src c ON c.id = q.client_id
  {POLICY_BREED_JOINS})
SELECT {QUOTE_OUT} FROM j WHERE rn = 1 AND PetType IS NOT NULL
""")
def fact_quote_a(src):
    return facts.quote_fact_a(src, *FW, DOM)


@register("fact_quote_b", ("quote_src", "client_src", "policy_src", "policy_full_src", "pet_type_dim",
                           "breed_dim", "hear_about_dim", "answer_src", "list_src", "question_dim"),
          ids="M2 J3-J8 J22 J23 C1-C10 C15 C28 F9 D11 D12 G2 G3 I1 N23", oracle=f"""
WITH q AS (SELECT * FROM quote_src
           WHERE created_date >= DATE '{LO}' AND created_date < DATE '{HI}' AND quote_parent_id IS NULL
             AND first_name NOT ILIKE '%test%' AND last_name NOT ILIKE '%test%'
             AND {MAIL_Q}
             AND pet_name NOT ILIKE '%test%'),
qa AS (SELECT * FROM q WHERE created_by IS NOT NULL AND quote_save_from IS NOT NULL
                         AND product_id IN ({BRANCH_A})),
tok AS (SELECT DISTINCT quote_id, TRY_CAST(trim(t) AS INTEGER) AS tid
        FROM (SELECT n.quote_id, unnest(string_split(l.answer, ',')) AS t
              FROM answer_src n JOIN list_src l ON l.answer_id = n.id
              WHERE n.question_id = {DOM.activity_question}
                AND n.quote_id IN (SELECT id FROM qa WHERE product_id = {BB})) s),
act AS (SELECT tok.quote_id, string_agg(d.question_detail_name, ', ' ORDER BY d.question_detail_name) AS bb_activity
        FROM tok JOIN question_dim d ON d.id = tok.tid GROUP BY tok.quote_id),
a AS (
  SELECT {QUOTE_COMMON_COLS},
     CASE WHEN q.product_id = {BB} THEN 'BB_Commercial' ELSE pty.pet_type_name END AS PetType,
     coalesce(CAST(q.is_pet_id_product AS INT), 0) AS is_pet_id,
     row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), q.email,
                                     CASE WHEN q.product_id = {BB} THEN act.bb_activity ELSE pty.pet_type_name END,
                                     q.pet_name
                        ORDER BY {RANK_ORDER}) AS rn
  FROM qa q
  LEFT JOIN client_src c ON c.id = q.client_id
  LEFT JOIN hear_about_dim h ON h.id = q.hear_about_us
  LEFT JOIN pet_type_dim pty ON pty.pet_type_id = {CLASS_CASE.format(p='q.product_id')}
  LEFT JOIN act ON act.quote_id = q.id
  {POLICY_BREED_JOINS}
  WHERE (q.product_id <> {BB} OR (q.product_id = {BB} AND h.name NOT IN {HEAR_EXCL}))),
b AS (
  SELECT {QUOTE_COMMON_COLS}, pty.pet_type_name AS PetType,
     coalesce(CAST(q.is_pet_id_product AS INT), 0) AS is_pet_id,
     row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), q.email,
                                     CASE WHEN q.product_id = {BB} THEN '' ELSE pty.pet_type_name END, q.pet_name
                        ORDER BY {RANK_ORDER}) AS rn
  FROM q
  LEFT JOIN client_src c ON c.id = q.client_id
  LEFT JOIN pet_type_dim pty
         ON pty.pet_type_id = CASE WHEN q.product_id IN ({BRANCH_B}) THEN {DOM.branch_b_pet_type} END
  {POLICY_BREED_JOINS}
  WHERE q.product_id IN ({BRANCH_B}) AND q.executive_id IS NOT NULL),
u AS (SELECT * FROM a WHERE rn = 1 UNION ALL SELECT * FROM b WHERE rn = 1)
SELECT CASE WHEN PetType = 'BB_Commercial' THEN 'BB' WHEN is_pet_id = 0 THEN 'BPIS'
            WHEN is_pet_id = 1 THEN 'PetId' ELSE 'Unknown' END AS Brand,
       {QUOTE_OUT.replace('Brand, ', '')}
FROM u
""")
def fact_quote_b(src):
    return facts.quote_fact_b(src, *FW, DOM)


SALES_FROM = f"""
FROM policy_full_src p
LEFT JOIN cancel_src pc ON pc.policy_id = p.id
LEFT JOIN client_src c ON p.client_id = c.id
LEFT JOIN (SELECT * FROM policy_src WHERE transaction_type_id = 1) pa ON pa.id = p.id
{{product_join}} product_dim po ON po.id = pa.product_id
LEFT JOIN quote_src q ON q.id = pa.quote_id
LEFT JOIN user_dim u ON p.executive_id = u.id
{{extra_joins}}
WHERE p.created_date >= DATE '{LO}' AND p.created_date < DATE '{HI}'
  AND coalesce(CAST(p.is_free_product AS INT), 0) = 0
  AND p.insured_name NOT ILIKE '%test%' AND p.pet_name NOT ILIKE '%test%'
  AND c.first_name NOT ILIKE '%test%' AND c.last_name NOT ILIKE '%test%'
  AND {MAIL_C}
  AND p.executive_id IS NOT NULL
  AND (pc.id IS NULL OR pc.created_date >= p.created_date + INTERVAL 1 DAY)
  {{extra_where}}
"""
SALE_METHOD = "CASE WHEN u.first_name IN ('FIT', 'Web') THEN 'Web' ELSE 'Phone' END"
SALES_ADAPTERS = ("policy_full_src", "cancel_src", "client_src", "policy_src", "product_dim",
                  "quote_src", "user_dim")


@register("fact_sales_a", SALES_ADAPTERS, ids="M3 J9-J14 C8 C11 C17 D6 D8 D10 D13", oracle=f"""
SELECT {BRAND} AS Brand, p.policy_number AS PolicyNumber, p.created_date AS CreatedDate,
       p.actual_start_date AS ActualStartDate, po.product_name AS ProductName,
       CASE WHEN po.product_code ILIKE '%CAT%' THEN 'Cat' WHEN po.product_code ILIKE '%DOG%' THEN 'Dog'
            WHEN po.product_code ILIKE '%EQUINE%' THEN 'Horse' WHEN po.product_code ILIKE '%HORSE%' THEN 'Horse'
            WHEN po.product_code ILIKE '%EXOTIC%' THEN 'Exotic' WHEN po.product_code ILIKE '%PROF%' THEN 'Professional'
            ELSE 'OTHER' END AS PetType,
       c.first_name AS ClientName, p.pet_name AS PetName, {SALE_METHOD} AS SaleMethod,
       q.quote_number AS QuoteNumber, q.created_date AS QuoteCreatedDate
""" + SALES_FROM.format(product_join="JOIN", extra_joins="",
                        extra_where="AND coalesce(CAST(p.is_migrated AS INT), 0) = 0"))
def fact_sales_a(src):
    return facts.sales_fact_a(src, *FW, DOM)


@register("fact_sales_b", SALES_ADAPTERS + ("hear_about_dim", "pet_type_dim"),
          ids="M4 J7 J8 J9-J14 C9 C10 C16 D11 D12 D13", oracle=f"""
WITH s AS (
SELECT p.policy_number AS PolicyNumber, p.created_date AS CreatedDate,
       p.actual_start_date AS ActualStartDate, po.product_name AS ProductName,
       CASE WHEN q.product_id = {BB} THEN 'BB_Commercial' ELSE pty.pet_type_name END AS PetType,
       c.first_name AS ClientName, p.pet_name AS PetName, {SALE_METHOD} AS SaleMethod,
       q.quote_number AS QuoteNumber, q.created_date AS QuoteCreatedDate,
       coalesce(CAST(p.is_pet_id_product AS INT), 0) AS is_pet_id
""" + SALES_FROM.format(
    product_join="LEFT JOIN",
    extra_joins=("LEFT JOIN hear_about_dim h ON q.hear_about_us = h.id\n"
                 f"LEFT JOIN pet_type_dim pty ON pty.pet_type_id = {SALES_CLASS_CASE.format(p='pa.product_id')}"),
    extra_where=(f"AND pa.product_id IN ({SALES_ALL}) AND (pa.product_id <> {BB} OR "
                 f"(pa.product_id = {BB} AND h.name NOT IN {HEAR_EXCL}))")) + """)
SELECT CASE WHEN is_pet_id = 1 THEN 'PetId' WHEN PetType ILIKE '%BB_COM%' THEN 'BB' ELSE 'BPIS' END AS Brand,
       PolicyNumber, CreatedDate, ActualStartDate, ProductName, PetType, ClientName, PetName, SaleMethod,
       QuoteNumber, QuoteCreatedDate
FROM s
""")
def fact_sales_b(src):
    return facts.sales_fact_b(src, *FW, DOM)


FREE_BUCKET = """CASE WHEN lower(coalesce(po.product_code, '')) LIKE '%cat%' THEN 'Cat'
            WHEN lower(coalesce(po.product_code, '')) LIKE '%dog%' THEN 'Dog'
            WHEN lower(coalesce(po.product_code, '')) LIKE '%horse%' THEN 'Horse'
            WHEN lower(coalesce(po.product_code, '')) LIKE '%exotic%' THEN 'Exotic'
            WHEN lower(coalesce(po.product_code, '')) LIKE '%bb_com%' THEN 'BB'
            ELSE 'Others' END"""
FREE_FROM = f"""
FROM policy_full_src p
JOIN (SELECT * FROM policy_src WHERE transaction_type_id = 1) pa ON pa.id = p.id
LEFT JOIN policy_status_dim ps ON ps.id = p.policy_status_id
{{how}} JOIN product_dim po ON po.id = pa.product_id
LEFT JOIN quote_src q ON q.id = pa.quote_id
{{how}} JOIN sub_agent_dim sa ON sa.id = q.sub_agent_id
LEFT JOIN state_dim st ON st.id = sa.state_id
LEFT JOIN user_dim u ON p.executive_id = u.id
WHERE p.is_free_product AND p.created_date >= DATE '{LO}' AND p.created_date < DATE '{HI}'
  AND {not_ilike('p.policy_number', DOM.free_number_patterns)} {{extra}}
"""
FREE_ADAPTERS = ("policy_full_src", "policy_src", "policy_status_dim", "product_dim", "quote_src",
                 "sub_agent_dim", "state_dim", "user_dim")
FREE_COLS = f"""q.quote_number AS QuoteNumber, p.policy_number AS PolicyNumber, p.created_date AS CreatedDate,
       sa.name AS SubAgentName, sa.agent_category_id AS AgentCategoryId"""
FREE_TAIL = f"""po.product_name AS ProductName, st.state_name AS StateName, {SALE_METHOD} AS SaleMethod,
       ps.policy_status_name AS PolicyStatusName"""


@register("fact_free_a", FREE_ADAPTERS, ids="M5 J14-J19 C8 C12 C17", oracle=f"""
SELECT {BRAND} AS Brand, {FREE_COLS}, {FREE_BUCKET} AS PetType, {FREE_TAIL}
""" + FREE_FROM.format(how="", extra=(
    f"AND {not_ilike('sa.email', DOM.free_agent_patterns_a)} AND coalesce(p.pet_name, pa.pet_name) NOT ILIKE '%TEST%'")))
def fact_free_a(src):
    return facts.free_fact_a(src, *FW, DOM)


@register("fact_free_b", FREE_ADAPTERS, ids="M6 J14-J19 C8 C12 C16", oracle=f"""
WITH f AS (
SELECT {FREE_COLS},
       CASE WHEN q.product_id = {BB} THEN 'BB_Commercial' ELSE {FREE_BUCKET} END AS PetType, {FREE_TAIL},
       coalesce(CAST(p.is_pet_id_product AS INT), 0) AS is_pet_id
""" + FREE_FROM.format(how="LEFT", extra=(
    "AND " + not_ilike("coalesce(sa.email, '')", DOM.free_agent_patterns_b))) + """)
SELECT CASE WHEN is_pet_id = 1 THEN 'PetId' WHEN PetType ILIKE '%BB_COM%' THEN 'BB' ELSE 'BPIS' END AS Brand,
       QuoteNumber, PolicyNumber, CreatedDate, SubAgentName, AgentCategoryId, PetType, ProductName,
       StateName, SaleMethod, PolicyStatusName
FROM f
""")
def fact_free_b(src):
    return facts.free_fact_b(src, *FW, DOM)


CRM_OUT = ", ".join(facts.CRM_COLUMNS)
BREED_KEY = "coalesce(nullif(q.breed_id1, 0), nullif(q.breed_id2, 0), nullif(q.breed_id3, 0))"


@register("fact_crm", ("quote_src", "product_dim", "client_src", "policy_src", "policy_full_src",
                       "policy_status_dim", "breed_dim"),
          ids="M7 J20 J21 J24 J25 J26 J27 G5 G6 G7 C13 C18 C23 C24 C25 D7", oracle=f"""
WITH qd AS (
  SELECT q.id AS QuoteId, q.quote_number AS QuoteNumber, q.created_date AS QuoteCreatedDate,
         q.quote_date AS QuoteStartDate, q.expire_date AS QuoteEndDate, q.first_name AS FirstName,
         q.last_name AS LastName, q.email AS Email,
         coalesce(q.mobile, q.primary_contact_number, c.primary_contact_number,
                  c.alternative_contact_number) AS ContactNo,
         CASE WHEN CAST(c.send_document_on_email AS INT) = 1 THEN 'Yes' ELSE 'No' END AS EmailConcent,
         q.pet_birth_date AS PetBirthDate, q.pet_name AS PetName,
         CASE WHEN pd.product_code ILIKE '%dog%' THEN 'Dog' WHEN pd.product_code ILIKE '%cat%' THEN 'Cat'
              WHEN pd.product_code ILIKE '%exotic%' THEN 'Exotic' WHEN pd.product_code ILIKE '%horse%' THEN 'Horse'
              ELSE pd.product_code END AS PetType,
         pd.is_free_product AS IsFreeProduct,
         CASE WHEN q.quote_save_from = 2 THEN 'Web' ELSE 'Phone' END AS QuoteReceivedMethod,
         CASE WHEN coalesce(q.expire_date, q.quote_date) IS NULL THEN NULL
              WHEN DATE '2001-07-10' > q.expire_date THEN 'Lapsed' ELSE 'Live' END AS QuoteStatus,
         {BREED_KEY} AS PetBreedId,
         row_number() OVER (
           PARTITION BY q.first_name, q.last_name, q.pet_name
           ORDER BY CASE WHEN EXISTS (SELECT 1 FROM policy_src x WHERE x.quote_id = q.id) THEN 0 ELSE 1 END,
                    q.quote_date DESC NULLS LAST,
                    CASE WHEN {BREED_KEY} IS NOT NULL THEN 0 ELSE 1 END, q.id) AS rn
  FROM quote_src q
  LEFT JOIN product_dim pd ON pd.id = q.product_id
  LEFT JOIN client_src c ON c.id = q.client_id
  WHERE q.quote_date >= DATE '{LO}' AND q.quote_date < DATE '{HI}'
    AND q.first_name NOT ILIKE '%Test%' AND q.last_name NOT ILIKE '%Test%'
    AND q.pet_name NOT ILIKE '%Test%' AND {not_ilike('q.email', DOM.crm_email_patterns)}),
pq AS (SELECT * FROM qd WHERE rn = 1),
lp AS (SELECT pa.quote_id, pa.policy_number, p.actual_start_date AS OriginalPolicyStartDate,
              p.actual_end_date AS PolicyEndDate, p.policy_status_id,
              row_number() OVER (PARTITION BY pa.quote_id
                                 ORDER BY pa.created_date DESC NULLS LAST, pa.policy_number) AS rn
       FROM policy_src pa JOIN policy_full_src p ON p.policy_number = pa.policy_number
       WHERE pa.quote_id IN (SELECT QuoteId FROM pq)),
pinfo AS (SELECT lp.quote_id, lp.policy_number AS PolicyNumber, lp.OriginalPolicyStartDate, lp.PolicyEndDate,
                 ps.policy_status_name AS PolicyStatusName
          FROM lp LEFT JOIN policy_status_dim ps ON ps.id = lp.policy_status_id WHERE lp.rn = 1),
fr AS (
  SELECT {BRAND} AS Brand, '' AS Country, '' AS BusinessName, '' AS BusinessType,
         CASE WHEN pinfo.PolicyNumber IS NOT NULL THEN
                CASE WHEN DATE '2001-07-10' < pinfo.PolicyEndDate THEN
                       CASE WHEN pinfo.PolicyStatusName IN ('AFRICA', 'AMERICA') THEN 'Active'
                            ELSE pinfo.PolicyStatusName END
                     ELSE 'Expired' END
              ELSE 'Quote' END AS CustomerStatus,
         CASE WHEN CAST(pq.IsFreeProduct AS INT) = 1 THEN 'Yes' ELSE 'No' END AS FreePolicy,
         pq.QuoteStatus, pq.QuoteNumber, pinfo.PolicyNumber, pq.QuoteReceivedMethod, pq.QuoteCreatedDate,
         pq.QuoteStartDate, pq.QuoteEndDate, pinfo.OriginalPolicyStartDate, pinfo.PolicyEndDate,
         pq.FirstName, pq.LastName, pq.Email, pq.ContactNo, pq.EmailConcent, pq.PetName, pq.PetType,
         pq.PetBirthDate, pq.PetBreedId, mb.breed_name AS BreedName
  FROM pq LEFT JOIN pinfo ON pinfo.quote_id = pq.QuoteId
          LEFT JOIN breed_dim mb ON mb.id = pq.PetBreedId),
dd AS (SELECT *, row_number() OVER (
          PARTITION BY CASE WHEN PolicyNumber IS NOT NULL THEN PolicyNumber
                            ELSE concat(coalesce(FirstName, ''), '|', coalesce(LastName, ''), '|',
                                        coalesce(PetName, '')) END
          ORDER BY CASE WHEN PolicyNumber IS NOT NULL THEN OriginalPolicyStartDate END DESC NULLS LAST,
                   QuoteCreatedDate DESC NULLS LAST, QuoteNumber ASC NULLS FIRST) AS final_rn
       FROM fr)
SELECT {CRM_OUT.replace("PetBreedId", "CAST(PetBreedId AS VARCHAR) AS PetBreedId")} FROM dd WHERE final_rn = 1
""")
def fact_crm(src):
    # PetBreedId is a nullable INT; the check compares it as text so pandas
    # dtypes (float with NaN vs nullable Int) cannot differ between engines.
    # The library column stays INT.
    from pyspark.sql import functions as F
    return facts.crm_fact(src, LO, HI, config.AS_OF, DOM).withColumn(
        "PetBreedId", F.col("PetBreedId").cast("string"))


SCRIPT_PERSON = """coalesce(q.first_name, c.first_name) AS FirstName, coalesce(q.last_name, c.last_name) AS LastName,
     coalesce(q.first_name, c.first_name) || ' ' || coalesce(q.last_name, c.last_name) AS FullName,
     q.email AS Email, q.pet_name AS PetName"""


@register("dedupe_set_based", ("quote_src", "client_src", "pet_type_dim", "hear_about_dim", "answer_src",
                               "list_src", "question_dim"),
          ids="G4 J22 J23 F9 I2 D12 N9 N23", oracle=f"""
WITH q AS (SELECT * FROM quote_src
           WHERE created_date >= DATE '{LO}' AND created_date < DATE '{HI}' AND quote_parent_id IS NULL
             AND first_name NOT ILIKE '%test%' AND last_name NOT ILIKE '%test%'
             AND {MAIL_Q}
             AND pet_name NOT ILIKE '%test%'),
tok AS (SELECT quote_id, TRY_CAST(trim(t) AS INTEGER) AS tid
        FROM (SELECT n.quote_id, unnest(string_split(l.answer, ',')) AS t
              FROM answer_src n JOIN list_src l ON l.answer_id = n.id
              WHERE n.question_id = {DOM.activity_question}) s),
ba AS (SELECT tok.quote_id, string_agg(d.question_detail_name, ', ' ORDER BY d.question_detail_name) AS BB_Activity
       FROM tok JOIN question_dim d ON d.id = tok.tid GROUP BY tok.quote_id),
a AS (
  SELECT q.id AS Id, {SCRIPT_PERSON},
     CASE WHEN q.product_id = {BB} THEN 'BB_Commercial' ELSE pty.pet_type_name END AS PetType,
     q.quote_number AS QuoteNumber, q.created_date AS CreatedDate,
     coalesce(CAST(q.is_pet_id_product AS INT), 0) AS IsPetId, ba.BB_Activity,
     row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), q.email,
                                     CASE WHEN q.product_id = {BB} THEN coalesce(ba.BB_Activity, 'BB_Commercial')
                                          ELSE pty.pet_type_name END, q.pet_name
                        ORDER BY q.id DESC) AS rn
  FROM q
  LEFT JOIN client_src c ON c.id = q.client_id
  LEFT JOIN hear_about_dim h ON h.id = q.hear_about_us
  LEFT JOIN pet_type_dim pty ON pty.pet_type_id = {CLASS_CASE.format(p='q.product_id')}
  LEFT JOIN ba ON ba.quote_id = q.id
  WHERE q.created_by IS NOT NULL AND q.quote_save_from IS NOT NULL AND q.product_id IN ({BRANCH_A})
    AND (q.product_id <> {BB} OR coalesce(h.name, '') NOT IN {HEAR_EXCL})),
b AS (
  SELECT q.id AS Id, {SCRIPT_PERSON}, pty.pet_type_name AS PetType,
     q.quote_number AS QuoteNumber, q.created_date AS CreatedDate,
     coalesce(CAST(q.is_pet_id_product AS INT), 0) AS IsPetId, CAST(NULL AS VARCHAR) AS BB_Activity,
     row_number() OVER (PARTITION BY CAST(q.created_date AS DATE), q.email, pty.pet_type_name, q.pet_name
                        ORDER BY q.id DESC) AS rn
  FROM q
  LEFT JOIN client_src c ON c.id = q.client_id
  LEFT JOIN pet_type_dim pty
         ON pty.pet_type_id = CASE WHEN q.product_id IN ({BRANCH_B}) THEN {DOM.branch_b_pet_type} END
  WHERE q.product_id IN ({BRANCH_B}) AND q.executive_id IS NOT NULL)
SELECT Id, FirstName, LastName, FullName, Email, PetName, PetType, QuoteNumber, CreatedDate, IsPetId, BB_Activity
FROM a WHERE rn = 1
UNION ALL
SELECT Id, FirstName, LastName, FullName, Email, PetName, PetType, QuoteNumber, CreatedDate, IsPetId, BB_Activity
FROM b WHERE rn = 1
""")
def dedupe_set_based(src):
    return facts.quote_dedupe_set_based(src, *FW, DOM)

"""Warehouse fact builders (M1-M7): source tables -> one wide fact.

Each builder is one lazy DataFrame plan: window filter on the driving table
first (pushed to the scan), then equi-joins.  Dimension tables (product, pet
type, breed, hear-about, user, state, status, sub-agent) are joined without
hints: Catalyst broadcasts them when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the real size at
run time, so a dimension that grows past the threshold falls back to a
shuffle join instead of blowing up executors.  Fan-out joins (quote ->
policy activity, policy -> cancellation) are made skew-safe: the quote facts
pre-reduce activities to the one row per quote the rank would keep
(``best_policy_per_quote``), and the sales facts count cancellations per
policy before they join them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.config import Domain
from ledgerlight.functions import columns as C
from ledgerlight.functions import filters as D
from ledgerlight.functions import periods as K
from ledgerlight.operators import dedupe, joins, listagg

Src = Mapping[str, DataFrame]

QUOTE_FACT_COLUMNS = [
    "Brand", "PolicyCreatedDate", "QuoteNumber", "CreatedDate", "QuoteStartDate",
    "QuoteExpiryDate", "QuoteReceivedMethod", "PolicyNumber", "PolicyStartDate", "PolicyEndDate",
    "FullName", "Email", "Address", "Suburb", "PostCode", "ContactNo", "PetName", "PetType",
    "PetBirthDate", "BreedName",
]


def _c(alias: str, col: str) -> Column:
    return F.col(f"{alias}.{col}")


def _by(src: Src, view: str, key: str) -> DataFrame:
    """A view laid out by ``key``, where the source can do that."""
    return src.by(view, key) if hasattr(src, "by") else src[view]


def _policy_links(src: Src) -> tuple[DataFrame, DataFrame]:
    """PolicyActivity (quote -> policy) and Policy attribute frames."""
    pa = _by(src, "policy_src", "quote_id").select(
        F.col("quote_id").alias("pa_quote_id"), F.col("id").alias("pa_policy_id"),
        F.col("policy_number").alias("pa_policy_number"))
    pp = src["policy_full_src"].select(
        F.col("id").alias("pp_id"), F.col("actual_start_date").alias("pp_start"),
        F.col("actual_end_date").alias("pp_end"), F.col("created_date").alias("pp_created"))
    return pa, pp


def _quote_person_columns(q: str = "q", c: str = "c") -> dict[str, Column]:
    """C1-C4 shared by both quote facts."""
    first = C.fallback(_c(q, "first_name"), _c(c, "first_name"))
    last = C.fallback(_c(q, "last_name"), _c(c, "last_name"))
    return {
        "FirstName": first,
        "LastName": last,
        "FullName": C.full_name(first, last),
        "Address1": C.fallback(_c(q, "address1"), _c(c, "address1")),
        "Address2": C.fallback(_c(q, "address2"), _c(c, "address2")),
        "Suburb": C.fallback(_c(q, "suburb"), _c(c, "suburb")),
        "PostCode": C.fallback(_c(q, "post_code"), _c(c, "post_code")),
        "ContactNo": C.first_non_null(_c(q, "mobile"), _c(q, "primary_contact_number"),
                                      _c(c, "primary_contact_number"),
                                      _c(c, "alternative_contact_number")),
    }


def best_policy_per_quote(src: Src, quote_ids: DataFrame) -> DataFrame:
    """J4 + J5 pre-reduced: the one policy activity per quote that the later
    keep-newest rank would pick.

    All fan-out rows of one quote share its id, so in the quote rank they
    only compete with each other, on ``policy created DESC NULLS LAST,
    policy number``.  Picking that row per quote *before* joining gives the
    same facts with no fan-out: the top-1 runs partially on every map task
    (a quote holding a third of all activities costs one row per task), and
    the quote join becomes 1:1.  ``quote_ids`` (the windowed quotes) limits
    the activities read to those that can match."""
    pa, pp = _policy_links(src)
    pa = pa.join(quote_ids.select(F.col("id").alias("pa_quote_id")), "pa_quote_id", "left_semi")
    links = pa.join(pp, F.col("pp_id") == F.col("pa_policy_id"), "left")
    return dedupe.latest_per_key(
        links, ["pa_quote_id"], [F.col("pp_created").desc_nulls_last(),
                                 F.col("pa_policy_number").asc_nulls_first()])


def _join_policy_and_breed(df: DataFrame, src: Src, best: DataFrame) -> DataFrame:
    """Latest policy of the quote (``best``, pre-reduced by
    ``best_policy_per_quote``), breed on the first non-zero breed id."""
    breed = src["breed_dim"].select(F.col("id").alias("breed_id"), F.col("breed_name").alias("BreedName"))
    return (df.join(best, F.col("q.id") == F.col("pa_quote_id"), "left")
              .withColumn("_breed_key", C.first_nonzero("q.breed_id1", "q.breed_id2", "q.breed_id3"))
              .join(breed, F.col("breed_id") == F.col("_breed_key"), "left"))


def _finish_quote(df: DataFrame) -> DataFrame:
    return df.select(*QUOTE_FACT_COLUMNS)


def quote_fact_a(src: Src, start, end, domain: Domain) -> DataFrame:
    """M1 (AU/NZ): quotes with product class, client fallback, newest quote
    per day x normalised mail x pet type x normalised pet name."""
    q = _driving(src, "quote_src", "created_date", start, end).alias("q")
    test = domain.quote_name_patterns
    base = q.where(D.conjunction([
        F.col("created_by").isNotNull(), F.col("quote_save_from").isNotNull(),
        F.col("quote_parent_id").isNull(),
        ~D.flag_is("is_pet_id_product", 1),
        F.col("migrated_quote_id").isNull(),
        D.exclude_like({"first_name": test, "last_name": test,
                        "email": domain.quote_email_patterns, "pet_name": test}, keep_null=True),
    ]))
    product = src["product_dim"].where(
        F.col("parent_product_id").isNotNull() & ~F.col("product_name").ilike(domain.introductory_pattern)
    ).select(F.col("id").alias("prod_id"), F.col("pet_type_id").alias("prod_pet_type_id"))
    pet = src["pet_type_dim"].select(F.col("pet_type_id").alias("pty_id"),
                                     F.col("pet_type_name").alias("pty_name"))
    client = src["client_src"].alias("c")
    # Quote id first: quotes and activities may lie by it already.
    j = _join_policy_and_breed(base, src, best_policy_per_quote(src, base))
    j = (j.join(product, F.col("prod_id") == F.col("q.product_id"), "inner")
          .join(pet, F.col("pty_id") == F.col("prod_pet_type_id"), "left")
          .join(client, F.col("c.id") == F.col("q.client_id"), "left"))
    person = _quote_person_columns()
    rows = j.select(
        F.col("q.id").alias("_qid"), F.col("pp_created"), F.col("pa_policy_number"),
        F.lit(domain.brand_constant).alias("Brand"),
        F.col("pp_created").alias("PolicyCreatedDate"),
        F.col("q.quote_number").alias("QuoteNumber"),
        F.col("q.created_date").alias("CreatedDate"),
        F.col("q.quote_date").alias("QuoteStartDate"),
        F.col("q.expire_date").alias("QuoteExpiryDate"),
        C.received_method("q.quote_save_from").alias("QuoteReceivedMethod"),
        F.col("pa_policy_number").alias("PolicyNumber"),
        F.col("pp_start").alias("PolicyStartDate"), F.col("pp_end").alias("PolicyEndDate"),
        person["FullName"].alias("FullName"), F.col("q.email").alias("Email"),
        C.address(person["Address1"], person["Address2"]).alias("Address"),
        person["Suburb"].alias("Suburb"), person["PostCode"].alias("PostCode"),
        person["ContactNo"].alias("ContactNo"),
        F.col("q.pet_name").alias("PetName"), F.col("pty_name").alias("PetType"),
        F.col("q.pet_birth_date").alias("PetBirthDate"), F.col("BreedName"),
        F.to_date("q.created_date").alias("_k1"), dedupe.normalised_key("q.email").alias("_k2"),
        dedupe.normalised_key("q.pet_name").alias("_k4"),
    )
    kept = dedupe.latest_per_key(
        rows, ["_k1", "_k2", "PetType", "_k4"],
        [F.col("_qid").desc(), F.col("pp_created").desc_nulls_last(),
         F.col("pa_policy_number").asc_nulls_first()])
    return _finish_quote(kept.where(F.col("PetType").isNotNull()))


def bb_activity(src: Src, quotes: DataFrame, domain: Domain) -> DataFrame:
    """Names of the listed answers, only for BB-product quotes."""
    answers = activity_answers(src, quotes.where(F.col("product_id") == domain.bb_product), domain)
    return listagg.lookup_list(answers, "quote_id", "answer", src["question_dim"], "id",
                               "question_detail_name", out_col="bb_activity")


def activity_answers(src: Src, quotes: DataFrame, domain: Domain) -> DataFrame:
    """``quote_id, answer`` of the activity question, for the given quotes."""
    ids = quotes.select(F.col("id").alias("quote_id"))
    asked = (src["answer_src"].where(F.col("question_id") == domain.activity_question)
             .select(F.col("id").alias("answer_id"), "quote_id").join(ids, "quote_id", "left_semi"))
    return src["list_src"].join(asked, "answer_id").select("quote_id", "answer")


def quote_fact_b(src: Src, start, end, domain: Domain) -> DataFrame:
    """M2 (UK/DE/AT): two product branches (I1 as UNION ALL, N23), each
    de-duplicated on its own key, then the brand rule C15."""
    q = _driving(src, "quote_src", "created_date", start, end).alias("q")
    test = domain.quote_name_patterns
    common = D.conjunction([
        F.col("quote_parent_id").isNull(),
        D.exclude_like({"first_name": test, "last_name": test,
                        "email": domain.quote_email_patterns, "pet_name": test}, keep_null=False),
    ])
    pet = src["pet_type_dim"].select(F.col("pet_type_id").alias("pty_id"),
                                     F.col("pet_type_name").alias("pty_name"))
    client = src["client_src"].alias("c")
    hear = src["hear_about_dim"].select(F.col("id").alias("h_id"), F.col("name").alias("h_name"))
    person = _quote_person_columns()

    def project(j: DataFrame, pet_type: Column, activity: Column, key3: Column) -> DataFrame:
        return j.select(
            F.col("q.id").alias("_qid"), F.col("pp_created"), F.col("pa_policy_number"),
            pet_type.alias("PetType"), C.default_flag("q.is_pet_id_product").alias("_is_pet_id"),
            F.col("pp_created").alias("PolicyCreatedDate"),
            F.col("q.quote_number").alias("QuoteNumber"),
            F.col("q.created_date").alias("CreatedDate"),
            F.col("q.quote_date").alias("QuoteStartDate"),
            F.col("q.expire_date").alias("QuoteExpiryDate"),
            C.received_method("q.quote_save_from").alias("QuoteReceivedMethod"),
            F.col("pa_policy_number").alias("PolicyNumber"),
            F.col("pp_start").alias("PolicyStartDate"), F.col("pp_end").alias("PolicyEndDate"),
            person["FullName"].alias("FullName"), F.col("q.email").alias("Email"),
            C.address(person["Address1"], person["Address2"]).alias("Address"),
            person["Suburb"].alias("Suburb"), person["PostCode"].alias("PostCode"),
            person["ContactNo"].alias("ContactNo"),
            F.col("q.pet_name").alias("PetName"),
            F.col("q.pet_birth_date").alias("PetBirthDate"), F.col("BreedName"),
            F.to_date("q.created_date").alias("_k1"), F.col("q.email").alias("_k2"),
            key3.alias("_k3"), F.col("q.pet_name").alias("_k4"),
        )

    # Branch A: class products + the BB product.
    qa = q.where(common & F.col("created_by").isNotNull() & F.col("quote_save_from").isNotNull()
                 & F.col("product_id").isin(domain.branch_a_products))
    qb = q.where(common & F.col("product_id").isin(domain.branch_b_products)
                 & F.col("executive_id").isNotNull())
    act = bb_activity(src, qa, domain).withColumnRenamed("quote_id", "act_quote_id")
    ja = (qa.join(client, F.col("c.id") == F.col("q.client_id"), "left")
            .join(hear, F.col("h_id") == F.col("q.hear_about_us"), "left")
            .join(pet, F.col("pty_id") == C.product_class("q.product_id", domain.class_products), "left")
            .join(act, F.col("act_quote_id") == F.col("q.id"), "left")
            .where(D.product_exclusion("q.product_id", domain.bb_product, "h_name",
                                       domain.excluded_hear_about)))
    # One pass over the activities serves both branches.
    best = best_policy_per_quote(src, qa.select("id").unionByName(qb.select("id")))
    ja = _join_policy_and_breed(ja, src, best)
    is_bb = F.col("q.product_id") == domain.bb_product
    a = project(ja, C.bb_pet_type("q.product_id", domain.bb_product, "pty_name"),
                F.col("bb_activity"), F.when(is_bb, F.col("bb_activity")).otherwise(F.col("pty_name")))

    # Branch B: the second product family, executive required.
    jb = (qb.join(client, F.col("c.id") == F.col("q.client_id"), "left")
            .join(pet, F.col("pty_id") == C.product_class(
                "q.product_id", {domain.branch_b_pet_type: domain.branch_b_products}), "left"))
    jb = _join_policy_and_breed(jb, src, best)
    b = project(jb, F.col("pty_name"), F.lit(""),
                F.when(is_bb, F.lit("")).otherwise(F.col("pty_name")))

    order = [F.col("_qid").desc(), F.col("pp_created").desc_nulls_last(),
             F.col("pa_policy_number").asc_nulls_first()]
    keys = ["_k1", "_k2", "_k3", "_k4"]
    kept = (dedupe.latest_per_key(a, keys, order, collation=domain.collation)
            .unionByName(dedupe.latest_per_key(b, keys, order, collation=domain.collation)))
    return kept.withColumn("Brand", C.brand_quote_uk("PetType", "_is_pet_id")).select(*QUOTE_FACT_COLUMNS)


SALES_FACT_COLUMNS = [
    "Brand", "PolicyNumber", "CreatedDate", "ActualStartDate", "ProductName", "PetType",
    "ClientName", "PetName", "SaleMethod", "QuoteNumber", "QuoteCreatedDate",
]


@dataclass(frozen=True)
class Window:
    """The windowed policies of one extraction and, for sources whose tables are
    large beside a window (``src.reduces``), their keys: written once with the
    policies' own activities, they cut cancellations, clients and quotes down
    before those are shuffled."""
    policies: DataFrame
    activities: DataFrame
    keys: DataFrame | None
    inside: Column

    def reduce(self, rows: DataFrame, row_key: str, key: str) -> DataFrame:
        return rows if self.keys is None else joins.reduced(rows, row_key, self.keys, key, self.inside)


def _driving(src: Src, view: str, date_col: str, start, end) -> DataFrame:
    """The rows of the extraction's window; a source that can read a window in
    parts does so."""
    rows = src.window(view, date_col, start, end) if hasattr(src, "window") else src[view]
    return rows.where(K.in_window(date_col, start, end))


def _policy_window(src: Src, policies: DataFrame, start, end) -> Window:
    pa = src["policy_src"].where(F.col("transaction_type_id") == 1).select(
        F.col("id").alias("pa_policy_id"), F.col("product_id").alias("pa_product_id"),
        F.col("quote_id").alias("pa_quote_id"), F.col("pet_name").alias("pa_pet_name"))
    if not getattr(src, "reduces", False):
        return Window(policies, pa, None, F.lit(True))
    ids = policies.select(F.col("id").alias("w_policy_id"), F.col("client_id").alias("w_client_id"),
                          F.col("created_date").alias("w_created"))
    keys = joins.written(ids.join(pa, F.col("pa_policy_id") == F.col("w_policy_id"), "left"), "policies")
    own = keys.where(F.col("pa_policy_id").isNotNull()).select(*pa.columns)
    return Window(policies, own, keys, K.in_window("w_created", start, end))


def _sales_joins(src: Src, start, end, domain: Domain, product_how: str) -> DataFrame:
    """J9-J14 shared by both sales facts."""
    p = _driving(src, "policy_full_src", "created_date", start, end)
    window = _policy_window(src, p, start, end)
    pa = window.activities.drop("pa_pet_name")
    # Only cancellations of the window's policies are counted.
    ids = p.select(F.col("id").alias("_rk")).where(F.col("_rk").isNotNull())
    pc = (src["cancel_src"].join(ids, F.col("policy_id") == F.col("_rk"), "left_semi") if window.keys is None
          else window.reduce(src["cancel_src"], "policy_id", "w_policy_id"))
    pc = (pc.groupBy(F.col("policy_id").alias("pc_policy_id"), F.col("created_date").alias("pc_created"))
          .agg(F.count(F.lit(1)).cast("int").alias("pc_n")))
    p = p.alias("p")
    client = window.reduce(src["client_src"], "id", "w_client_id").alias("c")
    product = src["product_dim"].select(F.col("id").alias("po_id"), F.col("product_name").alias("po_name"),
                                        F.col("product_code").alias("po_code"))
    quote = window.reduce(src["quote_src"], "id", "pa_quote_id").select(
                                    F.col("id").alias("q_id"), F.col("quote_number").alias("q_number"),
                                    F.col("created_date").alias("q_created"),
                                    F.col("product_id").alias("q_product_id"),
                                    F.col("hear_about_us").alias("q_hear_about"))
    user = src["user_dim"].select(F.col("id").alias("u_id"), F.col("first_name").alias("u_first"))
    test = domain.quote_name_patterns
    # J9 + D13: several late cancellations repeat the policy, as in the
    # reference, but nothing else of them is used.  They are counted per policy
    # and time before the shuffle, so a policy with very many of them costs a
    # few rows, and the policy is repeated by the count after the join.
    late = D.late_cancellation_keep("pc_policy_id", "pc_created", "p.created_date")
    return (p.join(pc, F.col("pc_policy_id") == F.col("p.id"), "left").where(late)
             .withColumn("_again", F.explode(F.sequence(F.lit(1), F.coalesce("pc_n", F.lit(1)))))
             .join(pa, F.col("pa_policy_id") == F.col("p.id"), "left")
             .join(client, F.col("p.client_id") == F.col("c.id"), "left")
             .join(product, F.col("po_id") == F.col("pa_product_id"), product_how)
             .join(quote, F.col("q_id") == F.col("pa_quote_id"), "left")
             .join(user, F.col("p.executive_id") == F.col("u_id"), "left")
             .where(D.conjunction([
                 D.flag_is("p.is_free_product", 0),
                 D.exclude_like({"p.insured_name": test, "p.pet_name": test, "c.first_name": test,
                                 "c.last_name": test, "c.email": domain.quote_email_patterns},
                                keep_null=False),
                 F.col("p.executive_id").isNotNull(),
             ])))


def sales_fact_a(src: Src, start, end, domain: Domain) -> DataFrame:
    """M3 (AU/NZ): sold, non-free, non-migrated policies; pet type from the
    product code (C11)."""
    j = _sales_joins(src, start, end, domain, "inner").where(D.flag_is("p.is_migrated", 0))
    return j.select(
        F.lit(domain.brand_constant).alias("Brand"), F.col("p.policy_number").alias("PolicyNumber"),
        F.col("p.created_date").alias("CreatedDate"), F.col("p.actual_start_date").alias("ActualStartDate"),
        F.col("po_name").alias("ProductName"),
        C.bucket("po_code", config.SALES_CODE_BUCKETS, config.SALES_CODE_DEFAULT,
                 lower=False, null_as_empty=False).alias("PetType"),
        F.col("c.first_name").alias("ClientName"), F.col("p.pet_name").alias("PetName"),
        C.sale_method("u_first", domain.web_user_names).alias("SaleMethod"),
        F.col("q_number").alias("QuoteNumber"), F.col("q_created").alias("QuoteCreatedDate"))


def sales_fact_b(src: Src, start, end, domain: Domain) -> DataFrame:
    """M4 (UK/DE/AT): M3 plus product whitelist, BB exclusion by hear-about,
    pet type by product class (C9, C10) and the brand rule C16."""
    pet = src["pet_type_dim"].select(F.col("pet_type_id").alias("pty_id"),
                                     F.col("pet_type_name").alias("pty_name"))
    hear = src["hear_about_dim"].select(F.col("id").alias("h_id"), F.col("name").alias("h_name"))
    all_products = [p for ids in domain.sales_class_products.values() for p in ids] + [domain.bb_product]
    j = (_sales_joins(src, start, end, domain, "left")
         .join(hear, F.col("q_hear_about") == F.col("h_id"), "left")
         .join(pet, F.col("pty_id") == C.product_class("pa_product_id", domain.sales_class_products), "left")
         .where(F.col("pa_product_id").isin(all_products)
                & D.product_exclusion("pa_product_id", domain.bb_product, "h_name",
                                      domain.excluded_hear_about)))
    pet_type = C.bb_pet_type("q_product_id", domain.bb_product, "pty_name")
    return j.select(
        C.brand_sales_uk(pet_type, C.default_flag("p.is_pet_id_product")).alias("Brand"),
        F.col("p.policy_number").alias("PolicyNumber"),
        F.col("p.created_date").alias("CreatedDate"), F.col("p.actual_start_date").alias("ActualStartDate"),
        F.col("po_name").alias("ProductName"), pet_type.alias("PetType"),
        F.col("c.first_name").alias("ClientName"), F.col("p.pet_name").alias("PetName"),
        C.sale_method("u_first", domain.web_user_names).alias("SaleMethod"),
        F.col("q_number").alias("QuoteNumber"), F.col("q_created").alias("QuoteCreatedDate"))


FREE_FACT_COLUMNS = [
    "Brand", "QuoteNumber", "PolicyNumber", "CreatedDate", "SubAgentName", "AgentCategoryId",
    "PetType", "ProductName", "StateName", "SaleMethod", "PolicyStatusName",
]


def _free_joins(src: Src, start, end, domain: Domain, inner: bool) -> DataFrame:
    """Free policies with status, product, quote, agent, state, user."""
    how = "inner" if inner else "left"
    p = _driving(src, "policy_full_src", "created_date", start, end).where(F.col("is_free_product") == F.lit(True))
    window = _policy_window(src, p, start, end)
    p, pa = p.alias("p"), window.activities
    ps = src["policy_status_dim"].select(F.col("id").alias("ps_id"),
                                         F.col("policy_status_name").alias("PolicyStatusName"))
    product = src["product_dim"].select(F.col("id").alias("po_id"), F.col("product_name").alias("po_name"),
                                        F.col("product_code").alias("po_code"))
    quote = window.reduce(src["quote_src"], "id", "pa_quote_id").select(
                                    F.col("id").alias("q_id"), F.col("quote_number").alias("q_number"),
                                    F.col("product_id").alias("q_product_id"),
                                    F.col("sub_agent_id").alias("q_sub_agent"))
    sa = src["sub_agent_dim"].select(F.col("id").alias("sa_id"), F.col("name").alias("sa_name"),
                                     F.col("agent_category_id").alias("sa_cat"),
                                     F.col("email").alias("sa_email"), F.col("state_id").alias("sa_state"))
    st = src["state_dim"].select(F.col("id").alias("st_id"), F.col("state_name").alias("st_name"))
    user = src["user_dim"].select(F.col("id").alias("u_id"), F.col("first_name").alias("u_first"))
    return (p.join(pa, F.col("pa_policy_id") == F.col("p.id"), "inner")
             .join(ps, F.col("ps_id") == F.col("p.policy_status_id"), "left")
             .join(product, F.col("po_id") == F.col("pa_product_id"), how)
             .join(quote, F.col("q_id") == F.col("pa_quote_id"), "left")
             .join(sa, F.col("sa_id") == F.col("q_sub_agent"), how)
             .join(st, F.col("st_id") == F.col("sa_state"), "left")
             .join(user, F.col("p.executive_id") == F.col("u_id"), "left")
             .where(D.not_like_any("p.policy_number", domain.free_number_patterns, keep_null=False)))


def _free_select(j: DataFrame, brand: Column, pet_type: Column, domain: Domain) -> DataFrame:
    return j.select(
        brand.alias("Brand"), F.col("q_number").alias("QuoteNumber"),
        F.col("p.policy_number").alias("PolicyNumber"), F.col("p.created_date").alias("CreatedDate"),
        F.col("sa_name").alias("SubAgentName"), F.col("sa_cat").alias("AgentCategoryId"),
        pet_type.alias("PetType"), F.col("po_name").alias("ProductName"),
        F.col("st_name").alias("StateName"),
        C.sale_method("u_first", domain.web_user_names).alias("SaleMethod"),
        F.col("PolicyStatusName"))


def free_fact_a(src: Src, start, end, domain: Domain) -> DataFrame:
    """M5 (AU/NZ): free policies sold through an agent (inner joins)."""
    j = _free_joins(src, start, end, domain, inner=True).where(
        D.not_like_any("sa_email", domain.free_agent_patterns_a, keep_null=False)
        & D.not_like_any(F.coalesce("p.pet_name", "pa_pet_name"), domain.free_pet_patterns, keep_null=False))
    pet = C.bucket("po_code", config.FREE_CODE_BUCKETS, config.FREE_CODE_DEFAULT)
    return _free_select(j, F.lit(domain.brand_constant), pet, domain)


def free_fact_b(src: Src, start, end, domain: Domain) -> DataFrame:
    """M6 (UK/DE/AT): left joins keep policies without agent; BB quote first."""
    j = _free_joins(src, start, end, domain, inner=False).where(
        D.not_like_any("sa_email", domain.free_agent_patterns_b, keep_null=True))
    pet = F.when(F.col("q_product_id") == domain.bb_product, F.lit(config.BB_PET_TYPE)).otherwise(
        C.bucket("po_code", config.FREE_CODE_BUCKETS, config.FREE_CODE_DEFAULT))
    brand = C.brand_sales_uk(pet, C.default_flag("p.is_pet_id_product"))
    return _free_select(j, brand, pet, domain)


CRM_COLUMNS = [
    "Brand", "Country", "BusinessName", "BusinessType", "CustomerStatus", "FreePolicy",
    "QuoteStatus", "QuoteNumber", "PolicyNumber", "QuoteReceivedMethod", "QuoteCreatedDate",
    "QuoteStartDate", "QuoteEndDate", "OriginalPolicyStartDate", "PolicyEndDate", "FirstName",
    "LastName", "Email", "ContactNo", "EmailConcent", "PetName", "PetType", "PetBirthDate",
    "PetBreedId", "BreedName",
]


def crm_fact(src: Src, start, end_exclusive, as_of, domain: Domain) -> DataFrame:
    """M7 customer 360: rank quotes per person and pet (G5, J21), attach the
    latest policy of the picked quote (J24-J26, G6), then keep one row per
    policy or per person|pet (G7)."""
    last_day = K.to_date(end_exclusive) - dt.timedelta(days=1)
    q = _driving(src, "quote_src", "quote_date", start, last_day).alias("q")
    pd_ = src["product_dim"].select(F.col("id").alias("pd_id"), F.col("product_code").alias("pd_code"),
                                    F.col("is_free_product").alias("pd_free"))
    client = src["client_src"].alias("c")
    pats = domain.crm_patterns
    base = q.where(D.conjunction([
        D.exclude_like({"first_name": pats, "last_name": pats, "email": domain.crm_email_patterns,
                        "pet_name": pats}, keep_null=False),
    ]))
    j = (base.join(pd_, F.col("pd_id") == F.col("q.product_id"), "left")
             .join(client, F.col("c.id") == F.col("q.client_id"), "left"))
    # J21, J24, J26, G6 in one reading of the activities: per windowed quote the
    # activity that a latest policy comes from, if any has one, else any other.
    # That a row is there is the existence flag.
    pa = src["policy_src"].select(F.col("quote_id").alias("lp_quote_id"),
                                  F.col("policy_number").alias("lp_number"),
                                  F.col("created_date").alias("lp_created"))
    pol = src["policy_full_src"].select(F.col("policy_number").alias("p_number"),
                                        F.col("actual_start_date").alias("OriginalPolicyStartDate"),
                                        F.col("actual_end_date").alias("PolicyEndDate"),
                                        F.col("policy_status_id").alias("p_status"))
    lp = (pa.join(base.select(F.col("id").alias("lp_quote_id")), "lp_quote_id", "left_semi")
            .join(pol, dedupe.collated("p_number", domain.collation) == dedupe.collated("lp_number", domain.collation), "left"))
    lp = dedupe.latest_per_key(lp, ["lp_quote_id"], [
        F.col("p_number").isNull().asc(), F.col("lp_created").desc(), F.col("lp_number").asc()])
    j = (j.join(lp, F.col("lp_quote_id") == F.col("q.id"), "left")
          .withColumn("_has_policy", F.col("lp_quote_id").isNotNull()))
    breed_key = C.first_nonzero("q.breed_id1", "q.breed_id2", "q.breed_id3")
    quotes = j.select(
        F.col("q.id").alias("QuoteId"), F.col("q.quote_number").alias("QuoteNumber"),
        F.col("q.created_date").alias("QuoteCreatedDate"), F.col("q.quote_date").alias("QuoteStartDate"),
        F.col("q.expire_date").alias("QuoteEndDate"), F.col("q.first_name").alias("FirstName"),
        F.col("q.last_name").alias("LastName"), F.col("q.email").alias("Email"),
        C.first_non_null("q.mobile", "q.primary_contact_number", "c.primary_contact_number",
                         "c.alternative_contact_number").alias("ContactNo"),
        C.yes_no("c.send_document_on_email").alias("EmailConcent"),
        F.col("q.pet_birth_date").alias("PetBirthDate"), F.col("q.pet_name").alias("PetName"),
        C.bucket("pd_code", config.CRM_CODE_BUCKETS, F.col("pd_code"), lower=False,
                 null_as_empty=False).alias("PetType"),
        F.col("pd_free").alias("IsFreeProduct"),
        C.received_method("q.quote_save_from").alias("QuoteReceivedMethod"),
        C.quote_status("q.expire_date", "q.quote_date", as_of).alias("QuoteStatus"),
        breed_key.alias("PetBreedId"), F.col("_has_policy"), F.col("p_number").alias("PolicyNumber"),
        "OriginalPolicyStartDate", "PolicyEndDate", "p_status")
    picked = dedupe.latest_per_key(
        quotes, ["FirstName", "LastName", "PetName"],
        [F.col("_has_policy").desc(), F.col("QuoteStartDate").desc(),
         F.col("PetBreedId").isNull().asc(), F.col("QuoteId").asc()], collation=domain.collation)

    ps = src["policy_status_dim"].select(F.col("id").alias("ps_id"),
                                         F.col("policy_status_name").alias("PolicyStatusName"))
    breed = src["breed_dim"].select(F.col("id").alias("b_id"), F.col("breed_name").alias("BreedName"))
    final = (picked.join(ps, F.col("ps_id") == F.col("p_status"), "left")
                   .join(breed, F.col("b_id") == F.col("PetBreedId"), "left"))
    final = final.select(
        F.lit(domain.brand_constant).alias("Brand"), F.lit("").alias("Country"),
        F.lit("").alias("BusinessName"), F.lit("").alias("BusinessType"),
        C.customer_status("PolicyNumber", "PolicyEndDate", "PolicyStatusName", as_of,
                          domain.active_status_names).alias("CustomerStatus"),
        C.yes_no("IsFreeProduct").alias("FreePolicy"),
        *[c for c in CRM_COLUMNS if c not in ("Brand", "Country", "BusinessName", "BusinessType",
                                              "CustomerStatus", "FreePolicy")])
    has_pol = F.col("PolicyNumber").isNotNull()
    key = F.when(has_pol, F.col("PolicyNumber")).otherwise(
        C.concat_null_as_empty("FirstName", F.lit("|"), "LastName", F.lit("|"), "PetName"))
    return dedupe.latest_per_key(
        final.withColumn("_g7", key), ["_g7"],
        [F.when(has_pol, F.col("OriginalPolicyStartDate")).desc(), F.col("QuoteCreatedDate").desc(),
         F.col("QuoteNumber").asc()], collation=domain.collation).select(*CRM_COLUMNS)


SCRIPT_DEDUPE_COLUMNS = [
    "Id", "FirstName", "LastName", "FullName", "Email", "PetName", "PetType", "QuoteNumber",
    "CreatedDate", "IsPetId", "BB_Activity",
]


def quote_dedupe_set_based(src: Src, start, end, domain: Domain) -> DataFrame:
    """G4 + J23 + I2: the set-based form of the UK quote de-duplication.

    The answer list is aggregated once per quote (no correlated lookup) and
    left-joined; a BB quote's third key is its activity list, or
    ``BB_Commercial`` when it has none; a BB quote with no hear-about name is
    kept (``ISNULL(name, '')``, N9).  The two branches are disjoint product
    families, so ``UNION ALL`` (no distinct shuffle)."""
    q = _driving(src, "quote_src", "created_date", start, end).alias("q")
    test = domain.quote_name_patterns
    common = D.conjunction([
        F.col("quote_parent_id").isNull(),
        D.exclude_like({"first_name": test, "last_name": test,
                        "email": domain.quote_email_patterns, "pet_name": test}, keep_null=False),
    ])
    pet = src["pet_type_dim"].select(F.col("pet_type_id").alias("pty_id"),
                                     F.col("pet_type_name").alias("pty_name"))
    client = src["client_src"].alias("c")
    hear = src["hear_about_dim"].select(F.col("id").alias("h_id"), F.col("name").alias("h_name"))
    activity = listagg.lookup_list(activity_answers(src, src["quote_src"].where(common), domain),
                                   "quote_id", "answer", src["question_dim"], "id",
                                   "question_detail_name", out_col="BB_Activity", distinct_ids=False
                                   ).withColumnRenamed("quote_id", "ba_quote_id")
    person = _quote_person_columns()

    def project(j: DataFrame, pet_type: Column, activity_col: Column, key3: Column) -> DataFrame:
        return j.select(
            F.col("q.id").alias("Id"), person["FirstName"].alias("FirstName"),
            person["LastName"].alias("LastName"), person["FullName"].alias("FullName"),
            F.col("q.email").alias("Email"), F.col("q.pet_name").alias("PetName"),
            pet_type.alias("PetType"), F.col("q.quote_number").alias("QuoteNumber"),
            F.col("q.created_date").alias("CreatedDate"),
            C.default_flag("q.is_pet_id_product").alias("IsPetId"),
            activity_col.alias("BB_Activity"),
            F.to_date("q.created_date").alias("_k1"), key3.alias("_k3"))

    is_bb = F.col("q.product_id") == domain.bb_product
    qa = q.where(common & F.col("created_by").isNotNull() & F.col("quote_save_from").isNotNull()
                 & F.col("product_id").isin(domain.branch_a_products))
    ja = (qa.join(client, F.col("c.id") == F.col("q.client_id"), "left")
            .join(hear, F.col("h_id") == F.col("q.hear_about_us"), "left")
            .join(pet, F.col("pty_id") == C.product_class("q.product_id", domain.class_products), "left")
            .join(activity, F.col("ba_quote_id") == F.col("q.id"), "left")
            .where(~is_bb | ~F.coalesce(F.col("h_name"), F.lit("")).isin(domain.excluded_hear_about)))
    a = project(ja, C.bb_pet_type("q.product_id", domain.bb_product, "pty_name"), F.col("BB_Activity"),
                F.when(is_bb, F.coalesce(F.col("BB_Activity"), F.lit(config.BB_PET_TYPE)))
                 .otherwise(F.col("pty_name")))
    qb = q.where(common & F.col("product_id").isin(domain.branch_b_products)
                 & F.col("executive_id").isNotNull())
    jb = (qb.join(client, F.col("c.id") == F.col("q.client_id"), "left")
            .join(pet, F.col("pty_id") == C.product_class(
                "q.product_id", {domain.branch_b_pet_type: domain.branch_b_products}), "left"))
    b = project(jb, F.col("pty_name"), F.lit(None).cast("string"), F.col("pty_name"))
    keys = ["_k1", "Email", "_k3", "PetName"]
    order = [F.col("Id").desc()]
    return (dedupe.latest_per_key(a, keys, order).unionByName(dedupe.latest_per_key(b, keys, order))
            .select(*SCRIPT_DEDUPE_COLUMNS))

"""Derived columns (C1-C31) as ``Column`` builders.

All of them are built-in expressions (``coalesce``, ``when``, ``concat``,
``ilike``) so they stay inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight import config


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fallback(primary: str | Column, secondary: str | Column) -> Column:
    """``ISNULL(q.x, c.x)``."""
    return F.coalesce(_col(primary), _col(secondary))


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first + ' ' + last`` -- NULL if either side is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def concat_null_as_empty(*parts: str | Column) -> Column:
    """``CONCAT(a, ', ', b)`` -- NULL parts count as ''."""
    return F.concat(*[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])


def address(address1: str | Column, address2: str | Column) -> Column:
    """``CONCAT(Address1, ', ', Address2)``."""
    return concat_null_as_empty(address1, F.lit(", "), address2)


def first_non_null(*cols: str | Column) -> Column:
    """C4: first non-null phone."""
    return F.coalesce(*[_col(c) for c in cols])


def first_nonzero(*cols: str | Column) -> Column:
    """First id that is neither NULL nor 0."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0)) for c in cols])


def transaction_type(save_from: str | Column) -> Column:
    """1, 2 -> NB; 0 -> Endorsement, Amendment; else Renew."""
    s = _col(save_from)
    return (F.when(s.isin(1, 2), F.lit(config.TRANSACTION_NB))
            .when(s == 0, F.lit(config.TRANSACTION_ENDORSEMENT))
            .otherwise(F.lit(config.TRANSACTION_RENEW)))


def received_method(save_from: str | Column) -> Column:
    """QuoteSaveFrom = 2 -> Web, else Phone."""
    return F.when(_col(save_from) == 2, F.lit(config.WEB)).otherwise(F.lit(config.PHONE))


def sale_method(user_first_name: str | Column,
                web_names: Sequence[str] = config.WEB_USER_NAMES) -> Column:
    """Executives named FIT/Web -> Web, else Phone (NULL -> Phone)."""
    return F.when(_col(user_first_name).isin(list(web_names)), F.lit(config.WEB)).otherwise(F.lit(config.PHONE))


def product_class(product: str | Column, class_products: dict[int, list[int]]) -> Column:
    """Product id -> pet-type id by ``IN`` lists; else NULL."""
    p = _col(product)
    expr = None
    for type_id, ids in class_products.items():
        expr = (F.when(p.isin(ids), F.lit(type_id)) if expr is None
                else expr.when(p.isin(ids), F.lit(type_id)))
    return expr if expr is not None else F.lit(None).cast("int")


def bb_pet_type(product: str | Column, bb_product: int, pet_type_name: str | Column) -> Column:
    """The BB product -> ``BB_Commercial`` else the looked-up name."""
    return F.when(_col(product) == bb_product, F.lit(config.BB_PET_TYPE)).otherwise(_col(pet_type_name))


def bucket(c: str | Column, rules: Sequence[tuple[str, str]], default: str | Column | None,
           lower: bool = True, null_as_empty: bool = True) -> Column:
    """C11-C14: ordered pattern bucketing; first matching pattern wins.

    ``lower`` compares ``lower(c)`` with the pattern as written (reports);
    otherwise the match is case-insensitive ``ilike`` (N3).  ``default`` may be
    a label, a column (C13 passthrough) or None.
    """
    v = _col(c)
    if null_as_empty:
        v = F.coalesce(v, F.lit(""))
    expr = None
    for pattern, label in rules:
        test = F.lower(v).like(pattern) if lower else v.ilike(pattern)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    if default is None:
        return expr
    dflt = F.lit(default) if isinstance(default, str) else default
    return expr.otherwise(dflt) if expr is not None else dflt


def report_pet_bucket(c: str | Column = "PetType") -> Column:
    """C14 with the report buckets."""
    return bucket(c, config.REPORT_PET_BUCKETS, config.REPORT_PET_DEFAULT)


def brand_quote_uk(pet_type: str | Column, is_pet_id: str | Column) -> Column:
    """BB_Commercial -> BB; IsPetId 0 -> BPIS; 1 -> PetId; else Unknown."""
    i = _col(is_pet_id)
    return (F.when(_col(pet_type) == config.BB_PET_TYPE, F.lit(config.BRAND_BB))
            .when(i == 0, F.lit(config.BRAND_BPIS))
            .when(i == 1, F.lit(config.BRAND_PET_ID))
            .otherwise(F.lit(config.BRAND_UNKNOWN)))


def brand_sales_uk(pet_type: str | Column, is_pet_id: str | Column) -> Column:
    """IsPetId = 1 -> PetId; pet type like BB_COM -> BB; else BPIS."""
    return (F.when(_col(is_pet_id) == 1, F.lit(config.BRAND_PET_ID))
            .when(_col(pet_type).ilike("%BB_COM%"), F.lit(config.BRAND_BB))
            .otherwise(F.lit(config.BRAND_BPIS)))


def quote_status(expiry: str | Column, start: str | Column, as_of: dt.date) -> Column:
    """Both dates NULL -> NULL; as_of > expiry -> Lapsed; else Live."""
    e, s = _col(expiry), _col(start)
    return (F.when(F.coalesce(e, s).isNull(), F.lit(None).cast("string"))
            .when(F.lit(as_of) > e, F.lit(config.QUOTE_LAPSED))
            .otherwise(F.lit(config.QUOTE_LIVE)))


def not_converted(policy_number: str | Column) -> Column:
    """D16/C19 core: no policy number, or the text ``none`` in it."""
    p = _col(policy_number)
    return p.isNull() | p.ilike("%none%")


def converted_quote(policy_number: str | Column) -> Column:
    """Yes/No."""
    return F.when(not_converted(policy_number), F.lit(config.NO)).otherwise(F.lit(config.YES))


def converted_flag(policy_number: str | Column) -> Column:
    """C20: BIT 0/1 as boolean."""
    return _col(policy_number).isNotNull()


def blank(c: str | Column) -> Column:
    """``NULLIF(LTRIM(RTRIM(c)), '') IS NULL``."""
    return F.nullif(F.trim(_col(c)), F.lit("")).isNull()


COMPLETENESS_FIELDS = ["FullName", "Email", "Address", "PostCode", "ContactNo", "PetType", "PetName"]


def incomplete(fields: Sequence[str] = COMPLETENESS_FIELDS) -> Column:
    """C21 core: any listed field blank."""
    out = None
    for f in fields:
        out = blank(f) if out is None else (out | blank(f))
    return out


def details_completed(fields: Sequence[str] = COMPLETENESS_FIELDS) -> Column:
    """Yes/No."""
    return F.when(incomplete(fields), F.lit(config.NO)).otherwise(F.lit(config.YES))


def agent_category(c: str | Column) -> Column:
    """Category id -> label; else NULL."""
    expr = None
    for k, v in config.AGENT_CATEGORIES.items():
        expr = (F.when(_col(c) == k, F.lit(v)) if expr is None
                else expr.when(_col(c) == k, F.lit(v)))
    return expr


def yes_no(flag: str | Column) -> Column:
    """flag = 1 (true) -> Yes else No."""
    return F.when(_col(flag).cast("int") == 1, F.lit(config.YES)).otherwise(F.lit(config.NO))


def customer_status(policy_number: str | Column, policy_end: str | Column,
                    status_name: str | Column, as_of: dt.date,
                    active_names: Sequence[str] = config.ACTIVE_STATUS_NAMES) -> Column:
    """No policy -> Quote; as_of >= end or end NULL -> Expired;
    Active/Converted -> Active; else the status name."""
    live = F.lit(as_of) < _col(policy_end)
    inner = (F.when(_col(status_name).isin(list(active_names)), F.lit(config.CUSTOMER_ACTIVE))
             .otherwise(_col(status_name)))
    return (F.when(_col(policy_number).isNull(), F.lit(config.CUSTOMER_QUOTE))
            .when(live, inner)
            .otherwise(F.lit(config.CUSTOMER_EXPIRED)))


def country(country_col: str | Column, code_col: str | Column) -> Column:
    """``COALESCE(NULLIF(Country, ''), CountryCode)``."""
    return F.coalesce(F.nullif(_col(country_col), F.lit("")), _col(code_col))


def default_flag(c: str | Column, default: int = 0) -> Column:
    """``ISNULL(flag, 0)``."""
    return F.coalesce(_col(c).cast("int"), F.lit(default))


def normalised_method(c: str | Column, null_key: str | None = "none") -> Column:
    """2.J pandas rule: ``lower(trim(method))`` with contact-centre aliases
    mapped to phone; NULL becomes the key ``'none'`` (or stays NULL)."""
    v = F.lower(F.trim(_col(c)))
    expr = F.when(v.isin(list(config.METHOD_ALIASES)), F.lit("phone")).otherwise(v)
    if null_key is not None:
        expr = F.coalesce(expr, F.lit(null_key))
    return expr


def millisecond(c: str | Column) -> Column:
    """Timestamps cut to millisecond precision."""
    return F.date_trunc("millisecond", _col(c))

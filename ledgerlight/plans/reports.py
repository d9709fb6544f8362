"""Management reports over the warehouse tables.

Each report part is a function ``(warehouse DataFrame, arguments) ->
DataFrame``; ``plans.api`` assembles the parts of one endpoint.  Arguments
are folded into literals, so the date window reaches the parquet scan as
``PushedFilters``, and on a table written by the loader the window also
carries the ``created_month`` range, so the scan prunes partitions.
Aggregates run as partial (map-side) + final hash aggregates; the only sorts
are pages (top-k, or a range-partitioned sort for deep pages) and exports.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import columns as C
from ledgerlight.functions import filters as D
from ledgerlight.functions import periods as K
from ledgerlight.operators import breakdown, load, paging, reshape


def _pruned(df: DataFrame, pred: Column, first, last, date_col: str) -> Column:
    """On a table written by the loader and partitioned by the month of
    ``date_col`` add the month range, so the scan prunes partitions; Spark
    cannot derive it from the date predicate itself."""
    if load.prunes(df, date_col):
        month = F.col(load.MONTH_COL)
        return pred & month.between(f"{first:%Y-%m}", f"{last:%Y-%m}")
    return pred


def _created_in(df: DataFrame, start, end, date_col: str = "CreatedDate") -> Column:
    """D5 window on ``date_col`` (inclusive end), partition-pruned when possible."""
    return _pruned(df, K.in_window(date_col, start, end), K.to_date(start), K.to_date(end), date_col)


def _created_half_open(df: DataFrame, start, end_exclusive, date_col: str = "CreatedDate") -> Column:
    """``start <= date_col < end_exclusive``, partition-pruned when possible."""
    last = K.to_date(end_exclusive) - dt.timedelta(days=1)
    return _pruned(df, K.in_half_open(date_col, start, end_exclusive), K.to_date(start), last, date_col)


def _rounded_percent_text(num: Column, den: Column) -> Column:
    """``round(100 * num / den, 1)`` half-up as text, ``.0`` dropped; 0 if den = 0."""
    n = F.floor((F.lit(2000) * num + den) / (F.lit(2) * den)).cast("bigint")
    text = F.when(n % 10 == 0, (F.floor(n / 10)).cast("bigint").cast("string")).otherwise(
        F.concat(F.floor(n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string")))
    return F.when(den > 0, text).otherwise(F.lit("0"))


def _percent2(num: Column, den: Column) -> Column:
    """``round(100 * num / den, 2)`` half-up as double; 0.0 if den = 0."""
    n = F.floor((F.lit(20000) * num + den) / (F.lit(2) * den))
    return F.when(den > 0, n / F.lit(100.0)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------
# M9: quote KPI summary + 13-month series
# ---------------------------------------------------------------------------

def quote_kpis(quote: DataFrame, start, end, as_of: dt.date,
               countries="all", brands="all", pets="all") -> DataFrame:
    """M9 summary row.

    Five conditional counts in one aggregate.  The union of the current and
    previous windows is added as a WHERE (user-level rewrite: Catalyst does
    not derive it from the CASE arms), so the scan reads only those days;
    ``count_if`` keeps the empty case at 0 (N10)."""
    cur = K.parse_dates(start, end)
    prev = K.previous_period(start, end)
    in_cur = K.in_half_open("CreatedDate", cur.start, cur.end_exclusive)
    in_prev = K.in_half_open("CreatedDate", prev.start, prev.end_exclusive)
    open_quote = C.not_converted("PolicyNumber")
    base = quote.where(D.conjunction([
        _created_half_open(quote, prev.start, cur.end_exclusive),
        D.report_filters(countries, brands, pets)]))
    kpi = base.agg(
        F.count_if(in_cur).alias("currentPeriodTotalQuotes"),
        F.count_if(in_prev).alias("lastPeriodTotalQuotes"),
        F.count_if(in_cur & (F.lit(as_of) <= F.col("QuoteExpiryDate")) & open_quote).alias("liveQuotes"),
        F.count_if(in_cur & (F.lit(as_of) > F.col("QuoteExpiryDate")) & open_quote).alias("lapsedQuotes"),
        F.count_if(in_cur & C.incomplete()).alias("incompleteQuoteDetails"),
    )
    return kpi.withColumn("quotesCompleteness", _rounded_percent_text(
        F.col("currentPeriodTotalQuotes") - F.col("incompleteQuoteDetails"),
        F.col("currentPeriodTotalQuotes")))


def monthly_series(spark: SparkSession, fact: DataFrame, date_col: str, count_col: str,
                   start, end, countries="all", brands="all", pets="all",
                   months: int = config.SERIES_MONTHS) -> DataFrame:
    """M9/M16 series (F5, K4, K6, K-wrap, K8): ``months`` month buckets ending
    in ``end``'s month, zero-filled.  If the user window lies in one calendar
    month, every month counts only the same day-of-month window (wrapping)."""
    s, e = K.to_date(start), K.to_date(end)
    oldest, upper = K.month_anchors(e, months)
    preds = [_created_half_open(fact, oldest, upper, date_col), D.report_filters(countries, brands, pets)]
    if K.same_calendar_month(s, e):
        preds.append(K.day_window_wrap(date_col, s.day, e.day))
    agg = (fact.where(D.conjunction(preds))
               .groupBy(K.month_start(date_col).alias("month"))
               .agg(F.count(count_col).alias("value")))
    cal = K.month_calendar(spark, oldest, K.add_months(upper, -1))
    out = reshape.align_to_calendar(cal, agg, "month", ["value"])
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"),
                      "value")


# ---------------------------------------------------------------------------
# Counts by pet bucket
# ---------------------------------------------------------------------------

def count_by_pet_bucket(fact: DataFrame, count_col: str, start, end,
                        countries="all", brands="all", pets="all") -> DataFrame:
    """M11/M17 (F4, C14): ``(name, value)`` per report pet bucket."""
    base = fact.where(D.conjunction([_created_in(fact, start, end),
                                     D.report_filters(countries, brands, pets)]))
    return (base.groupBy(C.report_pet_bucket("PetType").alias("name"))
                .agg(F.count(count_col).alias("value")))


def bucket_total(by_bucket: DataFrame) -> DataFrame:
    """M11 ``total``."""
    return by_bucket.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("total"))


# ---------------------------------------------------------------------------
# conversion
# ---------------------------------------------------------------------------

def conversion_same_period(quote: DataFrame, start, end, countries="all", brands="all",
                           pets="all") -> DataFrame:
    """M13 first form (F2, D17): quotes created in the window and how many of
    them got a policy created in the same window."""
    w = K.parse_dates(start, end)
    base = quote.where(D.conjunction([_created_in(quote, start, end),
                                      D.report_filters(countries, brands, pets)]))
    sold = (~C.not_converted("PolicyNumber")) & K.in_half_open("PolicyCreatedDate", w.start, w.end_exclusive)
    agg = base.agg(F.count("QuoteNumber").alias("total_quotes"),
                   F.count_if(sold).alias("converted"))
    return _conversion_shape(agg)


def _conversion_shape(agg: DataFrame) -> DataFrame:
    tq, cv = F.col("total_quotes"), F.col("converted")
    pct = _percent2(cv, tq)
    return agg.select(
        tq.cast("bigint").alias("total_quotes"), cv.cast("bigint").alias("converted"),
        pct.alias("conversion_percent"),
        F.greatest(tq - cv, F.lit(0)).cast("bigint").alias("not_converted"),
        F.when(tq > 0, (F.lit(10000) - F.floor((F.lit(20000) * cv + tq) / (F.lit(2) * tq))) / F.lit(100.0))
         .otherwise(F.lit(0.0)).alias("not_converted_percent"))


def conversion_v2(spark: SparkSession, quote: DataFrame, sales: DataFrame, start, end,
                  countries="all", brands="all", pets="all") -> DataFrame:
    """M13 production form (N22): sales of the last month of the 13-month
    sales series over quotes of the whole window."""
    e = K.to_date(end)
    quotes = quote.where(D.conjunction([_created_in(quote, start, end),
                                        D.report_filters(countries, brands, pets)])
                         ).agg(F.count("QuoteNumber").alias("total_quotes"))
    series = monthly_series(spark, sales, "CreatedDate", "PolicyNumber", start, end,
                            countries, brands, pets)
    last = paging.last_point(series, "period", f"{e.year:04d}-{e.month:02d}").select(
        F.col("value").alias("converted"))
    return _conversion_shape(paging.attach_scalars(quotes, last))


# ---------------------------------------------------------------------------
# Receive-method trend
# ---------------------------------------------------------------------------

def method_trend(spark: SparkSession, fact: DataFrame, method_col: str, count_col: str,
                 start, end, months: int | None = config.METHOD_TREND_MONTHS,
                 countries="all", brands="all", pets="all",
                 clamp_always: bool = False) -> DataFrame:
    """M15/M21 chart (K5, K-clamp, F6, L1, K8): per month, web and phone
    counts after method normalisation.  The day window is applied only when
    the user window is one calendar month (or always, for the listings).
    No matching row -> empty chart, not zeros."""
    s, e = K.to_date(start), K.to_date(end)
    used_start = K.lookback_start(s, e, months)
    preds = [_created_in(fact, used_start, e), D.report_filters(countries, brands, pets)]
    if clamp_always or K.same_calendar_month(s, e):
        preds.append(K.day_window_clamp("CreatedDate", s.day, e.day))
    agg = (fact.where(D.conjunction(preds))
               .groupBy(F.col(method_col).alias("method"), K.month_start("CreatedDate").alias("month"))
               .agg(F.count(count_col).alias("value")))
    norm = agg.withColumn("method", C.normalised_method("method"))
    wide = reshape.pivot_sum(norm, "month", "method", "value", config.TREND_METHODS)
    # The calendar is generated from the one-row count of the aggregate, so
    # no matching row gives no month at all (an empty chart, not zeros).
    cal = K.month_calendar_if_rows(agg, used_start, e)
    out = reshape.align_to_calendar(cal, wide, "month", config.TREND_METHODS)
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"),
                      *config.TREND_METHODS)


def method_totals(fact: DataFrame, method_col: str, count_col: str, start, end,
                  months: int | None = config.METHOD_TREND_MONTHS,
                  countries="all", brands="all", pets="all") -> DataFrame:
    """M15 totals (F8, F11, L3): trend totals keyed by normalised method, and
    the web/phone totals of the user's own window, in one frame
    ``(method, total, period_total)``."""
    s, e = K.to_date(start), K.to_date(end)
    used_start = K.lookback_start(s, e, months)
    flt = D.report_filters(countries, brands, pets)
    preds = [K.in_window("CreatedDate", used_start, e), flt]
    if K.same_calendar_month(s, e):
        preds.append(K.day_window_clamp("CreatedDate", s.day, e.day))
    in_period = K.in_window("CreatedDate", s, e)
    rows = fact.where(D.conjunction([_created_in(fact, min(used_start, s), e), flt]))
    trend_pred = D.conjunction(preds)
    return (rows.groupBy(C.normalised_method(method_col).alias("method"))
                .agg(F.count(F.when(trend_pred, F.col(count_col))).cast("bigint").alias("total"),
                     F.count(F.when(in_period, F.col(count_col))).cast("bigint").alias("period_total"))
                # A method met only outside both windows has no total.
                .where((F.col("total") > 0) | (F.col("period_total") > 0)))


def grand_total(parts: DataFrame, value: str, out: str) -> DataFrame:
    """The sum over a report's rows as a one-row frame, 0 without rows."""
    return parts.agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(out))


# ---------------------------------------------------------------------------
# Free-policy breakdown
# ---------------------------------------------------------------------------

def free_policy_breakdown(free: DataFrame, start, end, countries="all", brands="all",
                          pets="all") -> DataFrame:
    """M18 (F10, G9): status, pet type and channel breakdowns with shares
    from one scan."""
    base = free.where(D.conjunction([_created_in(free, start, end),
                                     D.report_filters(countries, brands, pets)]))
    return breakdown.breakdown_with_share(
        base, [("status", "PolicyStatusName"), ("pet_type", "PetType"), ("channel", "SaleMethod")])


# ---------------------------------------------------------------------------
# Policy reports over the CRM table
# ---------------------------------------------------------------------------

def _policy_base(crm: DataFrame, start, end, months, date_basis, regions, policy_status,
                 policy_type, brands, pets, collation: str | None = None) -> tuple[DataFrame, str]:
    s, e = K.to_date(start), K.to_date(end)
    basis = D.choose_date_basis(date_basis)
    used_start = K.lookback_start(s, e, months)
    preds = [
        _created_in(crm, used_start, e, basis),
        D.membership("CountryCode", D.normalize_regions(regions)),
        D.membership("Brand", D.normalize_input(brands)),
        D.pet_filter("PetType", D.normalize_input(pets)),
        D.membership("CustomerStatus", D.status_list(policy_status) or [], collation),
        D.membership("FreePolicy", D.free_policy_list(policy_type) or [], collation),
        K.day_window_clamp(basis, s.day, e.day),
    ]
    return crm.where(D.conjunction(preds)), basis


def policy_month_trend(crm: DataFrame, start, end, months: int | None = config.POLICY_TREND_MONTHS,
                       date_basis: str = config.DEFAULT_DATE_BASIS, regions="all",
                       policy_status="all", policy_type="all", brands="all",
                       pets="all", collation: str | None = None) -> DataFrame:
    """M22 (F7, D18-D21, K5, K-clamp always, K8 min..max observed)."""
    base, basis = _policy_base(crm, start, end, months, date_basis, regions, policy_status,
                               policy_type, brands, pets, collation)
    agg = base.groupBy(K.month_start(basis).alias("month")).agg(F.count(F.lit(1)).alias("policyCount"))
    cal = K.observed_calendar(agg, "month")
    out = reshape.align_to_calendar(cal, agg, "month", ["policyCount"])
    return out.select(K.period_key("month").alias("period"), K.month_label("month").alias("month_label"),
                      "policyCount")


POLICY_LISTING_COLUMNS = [
    "Brand", "Country", "BusinessName", "BusinessType", "CustomerStatus", "FreePolicy",
    "QuoteStatus", "QuoteNumber", "PolicyNumber", "QuoteReceivedMethod", "QuoteCreatedDate",
    "QuoteStartDate", "QuoteEndDate", "OriginalPolicyStartDate", "PolicyEndDate", "FirstName",
    "LastName", "Email", "ContactNo", "EmailConcent", "PetName", "PetType", "PetBirthDate",
    "PetBreedId", "BreedName", "CountryCode",
]


# The CSV puts the dates of the quote before the policy's number.
POLICY_EXPORT_COLUMNS = [
    "DateExtracted", "Brand", "Country", "BusinessName", "BusinessType", "CustomerStatus", "FreePolicy",
    "QuoteStatus", "QuoteNumber", "QuoteCreatedDate", "QuoteReceivedMethod", "QuoteStartDate",
    "QuoteEndDate", "PolicyNumber", "OriginalPolicyStartDate", "PolicyEndDate", "FirstName", "LastName",
    "Email", "ContactNo", "EmailConcent", "PetName", "PetType", "PetBirthDate", "PetBreedId",
    "BreedName", "CountryCode", "Converted",
]


def policy_order(rows: DataFrame, basis: str, order: str) -> list[paging.SortKey]:
    """H2: basis and direction, policy number, then every other column, so that
    pages never overlap even where numbers of several sources repeat."""
    lead = ["PolicyNumber", "QuoteNumber"]
    return [paging.SortKey(basis, D.sort_direction(order) == "DESC"), *paging.asc(*lead),
            *paging.asc(*[c for c in rows.columns if c not in (basis, "DateExtracted", *lead)])]


def policy_listing(crm: DataFrame, start, end, extracted_at: dt.datetime, months=None,
                   date_basis: str = config.DEFAULT_DATE_BASIS, regions="all",
                   policy_status="all", policy_type="all", brands="all", pets="all",
                   order: str = "DESC", skip: int = 0, limit: int = 100,
                   with_total: bool = True) -> DataFrame:
    """M23 (C20, C26, C27, H2, G8): CRM rows of the window, ordered by the
    chosen date basis and direction, then policy number, then a total order."""
    base, basis = _policy_base(crm, start, end, months, date_basis, regions, policy_status,
                               policy_type, brands, pets)
    rows = base.select(
        K.ntz_literal(extracted_at).alias("DateExtracted"),
        *[C.country("Country", "CountryCode").alias("Country") if c == "Country" else F.col(c)
          for c in POLICY_LISTING_COLUMNS],
        C.converted_flag("PolicyNumber").alias("Converted"))
    order_cols = policy_order(rows, basis, order)
    if with_total:
        return paging.page_with_total(rows, order_cols, skip, limit)
    return paging.page(rows, order_cols, skip, limit)


# ---------------------------------------------------------------------------
# listings
# ---------------------------------------------------------------------------

QUOTE_LISTING_COLUMNS = [
    "CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteStatus", "ConvertedQuote",
    "QuoteDetailsCompleted", "CreatedDate", "QuoteStartDate", "QuoteExpiryDate",
    "QuoteReceivedMethod", "FullName", "Email", "ContactNo", "PetName", "PetType", "BreedName",
    "PetBirthDate",
]

_TAIL = ["QuoteStartDate", "QuoteExpiryDate", "QuoteReceivedMethod", "FullName", "Email",
         "ContactNo", "PetName", "PetType", "BreedName", "PetBirthDate"]
_HEAD = ["CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteStatus", "ConvertedQuote"]

# Output shapes of the quote listings (column order as the reference emits them).
QUOTE_SHAPES: dict[str, list[str]] = {
    # M10 JSON page.
    "quote": QUOTE_LISTING_COLUMNS,
    # M10 CSV: adds the policy number and its creation date.
    "quote_csv": ["CountryName", "CountryCode", "Brand", "QuoteNumber", "CreatedDate", "PolicyNumber",
                  "PolicyCreatedDate", "QuoteStatus", "ConvertedQuote", "QuoteDetailsCompleted", *_TAIL],
    # No completeness column, no creation date (still ordered by it).
    "by_pet_type": [*_HEAD, *_TAIL],
    # M14 JSON / M15 listing: policy dates appended.
    "conversion": [*_HEAD, "CreatedDate", *_TAIL, "PolicyNumber", "PolicyStartDate", "PolicyEndDate"],
    # M14 CSV: creation date renamed.
    "conversion_csv": [*_HEAD, "QuoteCreatedDate", *_TAIL, "PolicyNumber", "PolicyStartDate",
                       "PolicyEndDate"],
}
_ORDER_KEY = "_order_created"


def quote_rows(quote: DataFrame, start, end, as_of: dt.date, countries="all", brands="all",
               pets="all", shape: str = "quote", months: int | None = None,
               clamp_days: bool = False) -> DataFrame:
    """M10/M12/M14/M15 rows (C18, C19, C21) before ordering.

    ``months`` widens the window to an N-month look-back (K5) and
    ``clamp_days`` applies the clamped day window in every month (K-clamp),
    as the receive-method listing does.  A hidden ``_order_created`` column
    carries the sort key; ``listing_order`` uses it and the page drops it."""
    s, e = K.to_date(start), K.to_date(end)
    preds = [_created_in(quote, K.lookback_start(s, e, months), e),
             D.report_filters(countries, brands, pets)]
    if clamp_days:
        preds.append(K.day_window_clamp("CreatedDate", s.day, e.day))
    base = quote.where(D.conjunction(preds))
    derived = {
        "QuoteStatus": C.quote_status("QuoteExpiryDate", "QuoteStartDate", as_of),
        "ConvertedQuote": C.converted_quote("PolicyNumber"),
        "QuoteDetailsCompleted": C.details_completed(),
        "QuoteCreatedDate": F.col("CreatedDate"),
    }
    cols = [derived[c].alias(c) if c in derived else F.col(c) for c in QUOTE_SHAPES[shape]]
    return base.select(*cols, F.col("CreatedDate").alias(_ORDER_KEY))


def listing_order(df: DataFrame, created: str = "CreatedDate", number: str = "QuoteNumber") -> list[paging.SortKey]:
    """H1: ``CreatedDate DESC, QuoteNumber`` then every other output column,
    so the order is total (the two reference keys may tie)."""
    if _ORDER_KEY in df.columns:
        created = _ORDER_KEY
    rest = [c for c in df.columns if c not in (created, number, _ORDER_KEY)]
    return [paging.desc(created), *paging.asc(number, *rest)]


def quote_listing(quote: DataFrame, start, end, as_of: dt.date, countries="all", brands="all",
                  pets="all", skip: int = 0, limit: int = 100, shape: str = "quote",
                  months: int | None = None, clamp_days: bool = False) -> DataFrame:
    """M10/M12/M14/M15 JSON page with its total (``COUNT(QuoteNumber)``)."""
    rows = quote_rows(quote, start, end, as_of, countries, brands, pets, shape, months, clamp_days)
    return paging.page_with_total(rows, listing_order(rows), skip, limit,
                                  count_col="QuoteNumber").drop(_ORDER_KEY)


def quote_export_rows(quote: DataFrame, start, end, as_of: dt.date, countries="all", brands="all",
                      pets="all", shape: str = "quote_csv", months: int | None = None,
                      clamp_days: bool = False) -> tuple[DataFrame, list[paging.SortKey]]:
    """M10/M12/M14/M15 CSV form: all rows of the window and their order."""
    rows = quote_rows(quote, start, end, as_of, countries, brands, pets, shape, months, clamp_days)
    return rows, listing_order(rows)


SALES_LISTING_COLUMNS = [
    "CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteCreatedDate", "PolicyNumber",
    "CreatedDate", "ActualStartDate", "ProductName", "PetType", "ClientName", "PetName",
    "SaleMethod",
]

FREE_LISTING_COLUMNS = [
    "CountryCode", "CreatedDate", "QuoteNumber", "PolicyNumber", "SubAgentName",
    "AgentCategoryId", "AgentCategory", "PetType", "ProductName", "StateName", "SaleMethod",
    "PolicyStatusName", "Brand",
]


def sales_listing(sales: DataFrame, start, end, countries="all", brands="all", pets="all",
                  skip: int = 0, limit: int = 100) -> DataFrame:
    """Sales page (duplicate output columns emitted once, N15)."""
    base = sales.where(D.conjunction([_created_in(sales, start, end),
                                      D.report_filters(countries, brands, pets)]))
    rows = base.select(*SALES_LISTING_COLUMNS)
    return paging.page_with_total(rows, listing_order(rows), skip, limit, count_col="PolicyNumber")


def free_listing(free: DataFrame, start, end, countries="all", brands="all", pets="all",
                 skip: int = 0, limit: int = 100) -> DataFrame:
    """Free-policy page with agent category labels."""
    base = free.where(D.conjunction([_created_in(free, start, end),
                                     D.report_filters(countries, brands, pets)]))
    rows = base.select(*[C.agent_category("AgentCategoryId").alias(c) if c == "AgentCategory"
                         else F.col(c) for c in FREE_LISTING_COLUMNS])
    return paging.page_with_total(rows, listing_order(rows), skip, limit, count_col="PolicyNumber")


SALES_EXPORT_COLUMNS = [
    "CountryName", "CountryCode", "Brand", "QuoteNumber", "QuoteCreatedDate", "PolicyNumber",
    "PolicyCreatedDate", "ActualStartDate", "ProductName", "PetType", "ClientName", "PetName",
]


def sales_export_rows(sales: DataFrame, start, end, countries="all", brands="all",
                      pets="all") -> tuple[DataFrame, list[paging.SortKey]]:
    """M20 CSV form (N15: the duplicated PetType is written once)."""
    base = sales.where(D.conjunction([_created_in(sales, start, end),
                                      D.report_filters(countries, brands, pets)]))
    rows = base.select(*[F.col("CreatedDate").alias(c) if c == "PolicyCreatedDate" else F.col(c)
                         for c in SALES_EXPORT_COLUMNS])
    return rows, listing_order(rows, created="PolicyCreatedDate", number="PolicyNumber")


FREE_EXPORT_COLUMNS = [
    "CountryCode", "CountryName", "QuoteNumber", "PolicyNumber", "CreatedDate", "SubAgentName",
    "AgentCategoryId", "AgentCategory", "PetType", "ProductName", "StateName", "SaleMethod",
    "PolicyStatusName", "Brand",
]


def free_export_rows(free: DataFrame, start, end, countries="all", brands="all",
                     pets="all") -> tuple[DataFrame, list[paging.SortKey]]:
    """M19 CSV form."""
    base = free.where(D.conjunction([_created_in(free, start, end),
                                     D.report_filters(countries, brands, pets)]))
    rows = base.select(*[C.agent_category("AgentCategoryId").alias(c) if c == "AgentCategory"
                         else F.col(c) for c in FREE_EXPORT_COLUMNS])
    return rows, listing_order(rows, number="PolicyNumber")


def policy_export_rows(crm: DataFrame, start, end, extracted_at: dt.datetime, months=None,
                       date_basis: str = config.DEFAULT_DATE_BASIS, regions="all",
                       policy_status="all", policy_type="all", brands="all", pets="all",
                       order: str = "DESC") -> tuple[DataFrame, list[paging.SortKey]]:
    """M23 CSV form: every row of the window in listing order."""
    base, basis = _policy_base(crm, start, end, months, date_basis, regions, policy_status,
                               policy_type, brands, pets)
    rows = base.select(
        K.ntz_literal(extracted_at).alias("DateExtracted"),
        *[C.country("Country", "CountryCode").alias("Country") if c == "Country" else F.col(c)
          for c in POLICY_LISTING_COLUMNS],
        C.converted_flag("PolicyNumber").alias("Converted")).select(*POLICY_EXPORT_COLUMNS)
    return rows, policy_order(rows, basis, order)

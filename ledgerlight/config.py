"""Domain constants.

The operators take every business constant (product-id lists, patterns,
labels, excluded names) from a ``Domain`` object, so the same code runs on the
production (pet insurance) domain and on the synthetic fixtures.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Must equal the reference's for identical report results.
# ---------------------------------------------------------------------------

# Report pet filter tokens -> LIKE pattern (case-insensitive).  The two BB
# tokens share one pattern; "_" is a one-character wildcard.
PET_PATTERNS = {
    "cat": "%cat%",
    "dog": "%dog%",
    "horse": "%horse%",
    "exotic": "%exotic%",
    "bbc": "%bb_com%",
    "bbcom": "%bb_com%",
}

# Report pet buckets: first match wins, else "Others".
REPORT_PET_BUCKETS = [
    ("%cat%", "Cat"),
    ("%dog%", "Dog"),
    ("%horse%", "Horse"),
    ("%exotic%", "Exotic"),
    ("%bb_com%", "BB"),
]
REPORT_PET_DEFAULT = "Others"

# AU/NZ sales: pet type from ProductCode.
SALES_CODE_BUCKETS = [
    ("%CAT%", "Cat"),
    ("%DOG%", "Dog"),
    ("%EQUINE%", "Horse"),
    ("%HORSE%", "Horse"),
    ("%EXOTIC%", "Exotic"),
    ("%PROF%", "Professional"),
]
SALES_CODE_DEFAULT = "OTHER"

# Free policies: pet type from ProductCode.
FREE_CODE_BUCKETS = [
    ("%cat%", "Cat"),
    ("%dog%", "Dog"),
    ("%horse%", "Horse"),
    ("%exotic%", "Exotic"),
    ("%bb_com%", "BB"),
]
FREE_CODE_DEFAULT = "Others"

# CRM: pet type from ProductCode, else the raw code.
CRM_CODE_BUCKETS = [
    ("%dog%", "Dog"),
    ("%cat%", "Cat"),
    ("%exotic%", "Exotic"),
    ("%horse%", "Horse"),
]

# Agent categories.
AGENT_CATEGORIES = {8: "Breeder", 7: "Pet Business", 6: "Charities", 5: "Vet"}

# Sale method: executives with these first names are the web channel.
WEB_USER_NAMES = ["FIT", "Web"]

# Receive-method normalisation.
METHOD_ALIASES = {"contact center": "phone", "contact_center": "phone"}
TREND_METHODS = ["web", "phone"]

# Quote transaction types by QuoteSaveFrom.
TRANSACTION_NB = "NB"
TRANSACTION_ENDORSEMENT = "Endorsement, Amendment"
TRANSACTION_RENEW = "Renew"

# Labels.
BB_PET_TYPE = "BB_Commercial"
BRAND_CONSTANT = "Petcover"
ACTIVE_STATUS_NAMES = ["Active", "Converted"]
WEB, PHONE = "Web", "Phone"
BRAND_BB, BRAND_BPIS, BRAND_PET_ID, BRAND_UNKNOWN = "BB", "BPIS", "PetId", "Unknown"
QUOTE_LAPSED, QUOTE_LIVE = "Lapsed", "Live"
YES, NO = "Yes", "No"
CUSTOMER_QUOTE, CUSTOMER_EXPIRED, CUSTOMER_ACTIVE = "Quote", "Expired", "Active"

# Test-row exclusion patterns (case-insensitive LIKE).
QUOTE_NAME_PATTERNS = ["%test%"]
QUOTE_EMAIL_PATTERNS = ["%petcovergroup%", "%prowerse%"]
CRM_PATTERNS = ["%Test%"]
CRM_EMAIL_PATTERNS = ["%Test%", "%prowerse%"]
FREE_NUMBER_PATTERNS = ["%TEST%"]
FREE_PET_PATTERNS = ["%TEST%"]
FREE_AGENT_PATTERNS_AU_NZ = ["%TEST%", "%PROWSE%", "%prowerse%", "%prower%"]
FREE_AGENT_PATTERNS_UK = ["%TEST%", "%PROW%"]
INTRODUCTORY_PATTERN = "%INTRODUCTORY%"

# Hear-about names whose BB quotes are dropped.
EXCLUDED_HEAR_ABOUT = [
    "Omnis 7 Commercial / Phoenix Migration Renewal",
    "Omnis 7 Commercial / Phoenix Migration Mid-Term",
]
CUSTOMER_STATUS_VALUES = ["Active", "Expired", "Quote", "Cancelled", "Lapsed"]

# Date bases a policy report may use.
POLICY_DATE_BASES = [
    "QuoteCreatedDate", "OriginalPolicyStartDate", "PolicyEndDate",
    "QuoteStartDate", "QuoteEndDate",
]
DEFAULT_DATE_BASIS = "QuoteCreatedDate"

# Paging.
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 10_000

# Trend lengths.
SERIES_MONTHS = 13
METHOD_TREND_MONTHS = 7
POLICY_TREND_MONTHS = 6

# Regions and their brand override (AT and DE carry the brand from the fact).
REGIONS = [
    ("NZ", "New Zealand", "au_nz"),
    ("AU", "Australia", "au_nz"),
    ("UK", "United Kingdom", "uk_de_at"),
    ("DE", "Germany", "uk_de_at"),
    ("AT", "Austria", "uk_de_at"),
]


# Spark's name of the collation that ignores case and trailing blanks.
NOCASE_KEYS = "UTF8_LCASE_RTRIM"


@dataclass(frozen=True)
class Domain:
    """Product/patterns configuration for the fact builders."""

    # UK/DE/AT quote branch A: pet-type id -> product ids; BB product.
    class_products: dict[int, list[int]]
    bb_product: int
    # UK/DE/AT quote branch B products (all one pet type).
    branch_b_products: list[int]
    branch_b_pet_type: int
    # BB quotes whose hear-about name is in this list are dropped.
    excluded_hear_about: list[str]
    # The question whose answers name a BB quote's activities.
    activity_question: int
    # Test-row exclusion patterns.
    quote_name_patterns: list[str] = field(default_factory=lambda: list(QUOTE_NAME_PATTERNS))
    quote_email_patterns: list[str] = field(default_factory=lambda: list(QUOTE_EMAIL_PATTERNS))
    crm_patterns: list[str] = field(default_factory=lambda: list(CRM_PATTERNS))
    crm_email_patterns: list[str] = field(default_factory=lambda: list(CRM_EMAIL_PATTERNS))
    free_number_patterns: list[str] = field(default_factory=lambda: list(FREE_NUMBER_PATTERNS))
    free_pet_patterns: list[str] = field(default_factory=lambda: list(FREE_PET_PATTERNS))
    free_agent_patterns_a: list[str] = field(default_factory=lambda: list(FREE_AGENT_PATTERNS_AU_NZ))
    free_agent_patterns_b: list[str] = field(default_factory=lambda: list(FREE_AGENT_PATTERNS_UK))
    introductory_pattern: str = INTRODUCTORY_PATTERN
    active_status_names: list[str] = field(default_factory=lambda: list(ACTIVE_STATUS_NAMES))
    web_user_names: list[str] = field(default_factory=lambda: list(WEB_USER_NAMES))
    # Brand of the single-brand regions.
    brand_constant: str = BRAND_CONSTANT
    # Collation of text keys: None compares bytes; NOCASE_KEYS compares as a
    # case-insensitive source does (case and trailing blanks ignored).
    collation: str | None = None

    @property
    def branch_a_products(self) -> list[int]:
        out = [p for ids in self.class_products.values() for p in ids]
        return out + [self.bb_product]

    @property
    def sales_class_products(self) -> dict[int, list[int]]:
        merged = {k: list(v) for k, v in self.class_products.items()}
        merged.setdefault(self.branch_b_pet_type, [])
        merged[self.branch_b_pet_type] = self.branch_b_products + merged[self.branch_b_pet_type]
        return merged


# The production product lists.
PET_DOMAIN = Domain(
    class_products={
        3: [2049, 2050, 2051, 2052],
        4: [2, 3, 4],
        6: [19, 20, 21, 22, 23, 25, 26, 28, 29],
        7: [6, 7, 8, 9, 10, 11, 12, 13, 14],
    },
    bb_product=2053,
    branch_b_products=list(range(2031, 2048)),
    branch_b_pet_type=3,
    excluded_hear_about=list(EXCLUDED_HEAR_ABOUT),
    activity_question=33024,
)

# The same rules on the synthetic fixtures (product ids are ``o_orderkey % 200``,
# pet types are nations, hear-about names are regions, statuses are regions).
FIXTURE_DOMAIN = Domain(
    class_products={
        3: list(range(0, 10)),
        4: list(range(10, 20)),
        6: list(range(20, 30)),
        7: list(range(30, 40)),
    },
    bb_product=40,
    branch_b_products=list(range(100, 120)),
    branch_b_pet_type=3,
    excluded_hear_about=["ASIA", "EUROPE"],
    activity_question=502,
    free_number_patterns=["%TEST%", "%7-3"],
    active_status_names=["AFRICA", "AMERICA"],
    quote_email_patterns=["%staff.example%", "%excluded%"],
    crm_email_patterns=["%Test%", "%excluded%"],
    free_agent_patterns_a=["%TEST%", "%STAFF%", "%excluded%", "%exclu%"],
    free_agent_patterns_b=["%TEST%", "%EXCL%"],
    brand_constant="House",
)

# Fixture regional sources: region code -> region key whose customers (with
# their orders and order lines) form that source.
FIXTURE_REGION_KEYS = {"NZ": 0, "AU": 1, "UK": 2, "DE": 3, "AT": 4}

# Fixed report parameters used by the driver queries (FIXTURES.md).
AS_OF = dt.date(2001, 7, 10)
MONTH_WINDOW = (dt.date(2001, 6, 5), dt.date(2001, 6, 20))
WIDE_WINDOW = (dt.date(2001, 1, 15), dt.date(2001, 6, 20))
CROSSING_WINDOW = (dt.date(2001, 5, 20), dt.date(2001, 6, 10))
MONTH_END_WINDOW = (dt.date(2001, 1, 31), dt.date(2001, 2, 28))
# Whole fixture range: facts and ETL read every row of the tables.
FULL_WINDOW = (dt.date(1994, 1, 1), dt.date(2002, 12, 31))

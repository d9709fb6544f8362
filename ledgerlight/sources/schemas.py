"""Warehouse table schemas (1.3).

A string's length limit is a matter of the target table: the catalog's
``VARCHAR(n)``, or field metadata (``max_length``) that ``with_widths`` declares.
The loader cuts strings to it (B3/B4) and reports how many values were cut;
without a declared limit nothing is cut.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Where Spark notes a catalog column's CHAR(n) or VARCHAR(n).
CATALOG_WIDTH = "__CHAR_VARCHAR_TYPE_STRING"


def _s(name: str) -> T.StructField:
    return T.StructField(name, T.StringType(), True)


def _ts(name: str) -> T.StructField:
    return T.StructField(name, T.TimestampNTZType(), True)


TAGS = [_s("CountryCode"), _s("CountryName"), _ts("ETLDateUploaded")]

QUOTE = T.StructType([
    _s("Brand"), _ts("PolicyCreatedDate"), _s("QuoteNumber"), _ts("CreatedDate"),
    _ts("QuoteStartDate"), _ts("QuoteExpiryDate"), _s("QuoteReceivedMethod"),
    _s("PolicyNumber"), _ts("PolicyStartDate"), _ts("PolicyEndDate"), _s("FullName"),
    _s("Email"), _s("Address"), _s("Suburb"), _s("PostCode"), _s("ContactNo"),
    _s("PetName"), _s("PetType"), _ts("PetBirthDate"), _s("BreedName"), *TAGS,
])

SALES = T.StructType([
    _s("Brand"), _s("PolicyNumber"), _ts("CreatedDate"), _ts("ActualStartDate"),
    _s("ProductName"), _s("PetType"), _s("ClientName"), _s("PetName"),
    _s("SaleMethod"), _s("QuoteNumber"), _ts("QuoteCreatedDate"), *TAGS,
])

FREE_POLICY = T.StructType([
    _s("Brand"), _s("QuoteNumber"), _s("PolicyNumber"), _ts("CreatedDate"),
    _s("SubAgentName"), T.StructField("AgentCategoryId", T.IntegerType(), True),
    _s("PetType"), _s("ProductName"), _s("StateName"), _s("SaleMethod"),
    _s("PolicyStatusName"), *TAGS,
])

CRM = T.StructType([
    _s("Brand"), _s("Country"), _s("BusinessName"), _s("BusinessType"),
    _s("CustomerStatus"), _s("FreePolicy"), _s("QuoteStatus"), _s("QuoteNumber"),
    _s("PolicyNumber"), _s("QuoteReceivedMethod"), _ts("QuoteCreatedDate"),
    _ts("QuoteStartDate"), _ts("QuoteEndDate"), _ts("OriginalPolicyStartDate"), _ts("PolicyEndDate"),
    _s("FirstName"), _s("LastName"), _s("Email"), _s("ContactNo"),
    _s("EmailConcent"), _s("PetName"), _s("PetType"), _ts("PetBirthDate"),
    T.StructField("PetBreedId", T.IntegerType(), True), _s("BreedName"), *TAGS,
])

WAREHOUSE = {"Quote": QUOTE, "Sales": SALES, "FreePolicySales": FREE_POLICY, "CRM": CRM}


def max_length(field: T.StructField) -> int | None:
    """Length limit of a column, if any: declared by ``with_widths``, or by
    the catalog as CHAR(n) or VARCHAR(n)."""
    meta = field.metadata or {}
    declared = re.search(r"char\((\d+)\)", meta.get(CATALOG_WIDTH, ""))
    n = meta.get("max_length") or (declared and declared.group(1))
    return int(n) if n else None


def with_widths(schema: T.StructType, widths: dict[str, int]) -> T.StructType:
    """The schema with length limits declared for some string columns."""
    return T.StructType([
        T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), "max_length": widths[f.name]})
        if f.name in widths else f for f in schema.fields])

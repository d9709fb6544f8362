"""Sorted listings, pages and totals.

A page is cut by rank.  As long as more than ``TOP_ROWS`` rows lie before the
page in what is left to sort, the sort key is refined: one aggregate counts the
rows in at most ``BUCKETS`` buckets of the key's next digit (a number that grows
with the key: the day, the second, seven bytes of a text), and only the bucket
that holds the page's first row is looked at further, down to single values and
on to the next column where many rows share a value.  The page is then
``WHERE key >= boundary ORDER BY ... OFFSET rest LIMIT limit``, which Spark plans
as ``TakeOrderedAndProject``: a task keeps ``TOP_ROWS + limit`` rows at most
(``limit`` is capped at 10 000, D23), whatever ``skip`` is, nothing is written
and nothing is sorted as a whole.  A first page needs no refinement at all.  A
reader that goes on from page to page uses ``page_after``, which starts behind
the last row it was given and counts nothing.

The total is its own aggregate (partial counts per task, one final merge),
never ``COUNT(*) OVER ()``, which would pull every row through one partition
(N24).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.filters import page_args

# Rows before a page that its top-k may carry, and buckets of one count.
TOP_ROWS, BUCKETS = 10_000, 4096
# Bytes of a text that one digit holds.
TEXT_BYTES = 7
_EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class SortKey:
    """One column of an order; nulls come first ascending and last descending."""
    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()


def asc(*names: str) -> list[SortKey]:
    return [SortKey(n) for n in names]


def desc(name: str) -> SortKey:
    return SortKey(name, True)


def sort_columns(order: Sequence[SortKey]) -> list[Column]:
    return [k.column() for k in order]


# ---- digits of a key --------------------------------------------------------

def _text_digit(col: Column, i: int) -> Column:
    """Bytes 7i .. 7i + 6 as a number; missing bytes count as zero."""
    part = F.hex(F.substring(col.cast("binary"), TEXT_BYTES * i + 1, TEXT_BYTES))
    return F.conv(F.rpad(part, 2 * TEXT_BYTES, "0"), 16, 10).cast("long")


def digits(kind: T.DataType, col: Column, longest: int) -> list[Column]:
    """Numbers that together never fall while the key grows.  ``longest``: bytes
    of the longest text in the column."""
    if isinstance(kind, T.StringType):
        return [_text_digit(col, i) for i in range(-(-longest // TEXT_BYTES) or 1)]
    if isinstance(kind, T.TimestampNTZType):
        clock = (F.hour(col) * 60 + F.minute(col)) * 60 + F.second(col)
        return [F.unix_date(F.to_date(col)).cast("long"), clock.cast("long"), F.date_format(col, "SSSSSS").cast("long")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(col)]
    if isinstance(kind, T.DateType):
        return [F.unix_date(col).cast("long")]
    if isinstance(kind, T.LongType):  # halves, so that no difference overflows
        return [F.shiftright(col, 32), col.bitwiseAND(F.lit((1 << 32) - 1))]
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [col.cast("long")]
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return [F.isnan(col.cast("double")).cast("long"), F.when(F.isnan(col.cast("double")), 0.0).otherwise(col.cast("double"))]
    raise TypeError(f"no page order on {kind.simpleString()}")


def _literal(kind: T.DataType, value: int) -> Column | None:
    """The least key with the first digit ``value``, for types whose filters
    reach the scan."""
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(_EPOCH + dt.timedelta(days=value)).cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        return F.lit(_EPOCH + dt.timedelta(days=value))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(kind, T.LongType):
        return F.lit(value << 32) if -(1 << 31) <= value < 1 << 31 else None
    return F.lit(value) if isinstance(kind, T.IntegralType) else None


@dataclass
class Boundary:
    """Where a page begins: ``rest`` rows of ``start`` (and behind) come first."""
    start: Column
    rest: int
    # Rows that share every key with the first, if that many cannot be told apart.
    copies: Column | None = None
    n_copies: int = 0
    passes: int = 0
    edges: list[Column] = field(default_factory=list)


def _behind(digit: Column, value, descending: bool) -> Column:
    """Digit (already turned for descending keys) after ``value`` in the order."""
    if value is None:
        return F.lit(False) if descending else digit.isNotNull()
    return digit.isNull() | (digit > value) if descending else F.coalesce(digit > value, F.lit(False))


def boundary(df: DataFrame, order: Sequence[SortKey], skip: int, limit: int, top_rows: int = TOP_ROWS) -> Boundary:
    """The first row of the page, as conditions on the key."""
    found = Boundary(F.lit(True), skip)
    equal: list[Column] = []  # digits fixed so far
    after: list[Column] = []  # ways to lie behind them
    size = None
    for place, key in enumerate(order):
        kind, col = df.schema[key.name].dataType, F.col(key.name)
        if found.rest <= top_rows:
            break
        longest = 0
        if isinstance(kind, T.StringType):
            longest = df.where(_all(equal)).agg(F.max(F.octet_length(col))).first()[0] or 0
            found.passes += 1
        for step, digit in enumerate(digits(kind, col, longest)):
            if found.rest <= top_rows:
                break
            digit = -digit if key.descending else digit
            rows = df.where(_all(equal))
            n, valued, low, high = rows.agg(F.count(F.lit(1)), F.count(digit), F.min(digit), F.max(digit)).first()
            found.passes += 1
            nulls = n - valued
            ahead = valued if key.descending else 0  # rows before the nulls
            if found.rest >= n:  # behind the last row
                return Boundary(F.lit(False), 0, passes=found.passes)
            if ahead <= found.rest < ahead + nulls:
                found.rest, size = found.rest - ahead, nulls
                after.append(_all(equal) & _behind(digit, None, key.descending))
                equal.append(digit.isNull())
                break  # a null has no further digits
            found.rest -= 0 if key.descending else nulls
            size = valued
            stuck = False
            while low < high and found.rest > top_rows:
                if stuck:  # doubles that are too near to part: a bucket each
                    bucket = digit
                elif isinstance(low, int):
                    bucket = F.call_function("div", digit - F.lit(low), F.lit(-(-(high - low + 1) // BUCKETS)))
                else:
                    bucket = F.floor((digit - F.lit(low)) / F.lit(max((high - low) / BUCKETS, 5e-324)))
                counts = (rows.where(digit.between(low, high)).groupBy(bucket.alias("b"))
                          .agg(F.count(F.lit(1)).alias("n"), F.min(digit).alias("low"), F.max(digit).alias("high")).collect())
                found.passes += 1
                wanted, passed = found.rest + limit, 0
                for c in sorted(counts, key=lambda c: c["low"]):
                    if passed <= found.rest < passed + c["n"]:
                        inside, before = c, passed
                    passed += c["n"]
                    if place == 0 and step == 0 and passed >= wanted:
                        # Nothing behind this bucket belongs to the page.
                        found.edges = _edge(kind, col, key, c["high"], upper=True)
                        break
                found.rest -= before
                stuck = (inside["low"], inside["high"]) == (low, high)
                low, high, size = inside["low"], inside["high"], inside["n"]
            if place == 0 and step == 0:
                found.edges = found.edges + _edge(kind, col, key, low, upper=False)
            after.append(_all(equal) & _behind(digit, high, key.descending))
            equal.append(digit.between(low, high))
            if low < high:
                break
    found.start = reduce(lambda a, b: a | b, after, _all(equal)) if equal else F.lit(True)
    if found.rest > top_rows:
        # Every key is used up: rows that no key tells apart.
        found.copies, found.n_copies = _all(equal), size - found.rest
        found.start, found.rest = reduce(lambda a, b: a | b, after, F.lit(False)), 0
    return found


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _edge(kind: T.DataType, col: Column, key: SortKey, turned, upper: bool) -> list[Column]:
    """A plain bound on the first key that a scan can use: rows up to (``upper``)
    or from the digit ``turned`` on."""
    value = -turned if key.descending else turned
    # Descending keys end below and begin above.
    if upper != key.descending:
        bound = _literal(kind, value + 1)
        return [] if bound is None else [col < bound if not key.descending or upper else (col < bound) | col.isNull()]
    bound = _literal(kind, value)
    return [] if bound is None else [(col >= bound)]


def page(df: DataFrame, order: Sequence[SortKey], skip: int = 0, limit: int = 100,
         top_rows: int = TOP_ROWS) -> DataFrame:
    """H1/H3: ``ORDER BY ... OFFSET skip FETCH NEXT limit``.  ``order`` must end
    with a unique key so pages never overlap."""
    skip, limit = page_args(skip, limit)
    found = boundary(df, order, skip, limit, top_rows)
    rows = df.where(_all([found.start, *found.edges])) if found.passes else df
    if found.copies is not None:
        head = min(limit, found.n_copies)
        copies = df.where(found.copies).limit(head)
        if head == limit:
            return copies
        behind = rows.orderBy(*sort_columns(order)).limit(limit - head)
        return copies.unionByName(behind).orderBy(*sort_columns(order)).limit(limit)
    out = rows.orderBy(*sort_columns(order))
    if found.rest:
        out = out.offset(found.rest)
    return out.limit(limit)


def page_after(df: DataFrame, order: Sequence[SortKey], last: Mapping[str, Any], limit: int = 100) -> DataFrame:
    """The page behind the row ``last`` (its sort keys by name): no rows are
    counted or skipped, so the hundredth page costs what the second does."""
    _, limit = page_args(0, limit)
    ways, equal = [], []
    for key in order:
        col, value = F.col(key.name), last[key.name]
        if value is None:
            beyond = F.lit(False) if key.descending else col.isNotNull()
            same = col.isNull()
        else:
            value = F.lit(value).cast(df.schema[key.name].dataType)
            beyond = (col < value) | col.isNull() if key.descending else col > value
            same = col == value
        ways.append(_all([*equal, F.coalesce(beyond, F.lit(False))]))
        equal.append(same)
    first, value = order[0], last[order[0].name]
    rows = df.where(reduce(lambda a, b: a | b, ways))
    if value is not None and not first.descending:
        # The plain form of the first bound, for the scan.
        rows = rows.where(F.col(first.name) >= F.lit(value).cast(df.schema[first.name].dataType))
    return rows.orderBy(*sort_columns(order)).limit(limit)


def total(df: DataFrame, count_col: str | None = None, out_col: str = "TotalRecords") -> DataFrame:
    """``COUNT(col)`` (non-NULL) or ``COUNT(*)`` as a one-row frame."""
    expr = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    return df.agg(expr.cast("bigint").alias(out_col))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row
    of ``df``.  The right side is a global aggregate, so its size is one row
    by construction; it is broadcast (nested-loop join without condition),
    which never multiplies ``df``'s rows."""
    return df.join(F.broadcast(one_row), how="cross")


def page_with_total(df: DataFrame, order: Sequence[SortKey], skip: int = 0, limit: int = 100,
                    count_col: str | None = None, out_col: str = "TotalRecords") -> DataFrame:
    """G8 rebuilt: the page with the (always right) total on every row.

    The total is a one-row aggregate; joining a one-row frame is a broadcast
    of provably bounded size onto at most ``limit`` rows."""
    pg = page(df, order, skip, limit)
    return attach_scalars(pg, total(df, count_col, out_col))


def last_point(series: DataFrame, month_col: str, month) -> DataFrame:
    """H5: the series' last element, selected by its month (no sort)."""
    return series.where(F.col(month_col) == F.lit(month))

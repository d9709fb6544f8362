"""Mixing of sources to target weights by temperature (op 1).

Source token shares are raised to an exponent between 0 (even) and 1 (as they
are) and normalised.  Bisection finds the exponent that meets a target: the
largest one whose weights have at least a given entropy, or the smallest one
that repeats no source more than a given number of times.  The weights become
token budgets, and the budgets a stream of blocks: each source is passed over
in a fresh permutation as often as its budget lasts, and every block takes
each source's share.

Permutations are hash orders.  Running token sums within a source, however
large, come from two levels: sums of hash ranges of a few thousand rows each,
added up per source, and running sums within a range.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlight.llm.common import cut, whole_text, words_of

# Bisection steps per pass over the shares, and passes.
HALVINGS, PASSES = 5, 8
ROWS_PER_RANGE = 4_096


@dataclass(frozen=True)
class Mix:
    """What was found: the exponent, the budget in tokens, and the weight of one
    share unit (weights are ``scale * share ** exponent``)."""

    exponent: float
    budget: float
    scale: float


def n_tokens(text: str | Column) -> Column:
    return F.size(words_of(whole_text(text))).cast("long")


def _evaluate(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(sum of share**a, entropy, least weight per share relative to most) for each exponent."""
    p = F.col("share")
    sums = []
    for i, a in enumerate(exponents):
        q = F.pow(p, F.lit(a))
        sums += [F.sum(q).alias(f"z{i}"), F.sum(q * F.log(q)).alias(f"l{i}"),
                 F.max(q / p).alias(f"hi{i}"), F.min(q / p).alias(f"lo{i}")]
    r = shares.agg(*sums).first()
    out = []
    for i in range(len(exponents)):
        z = r[f"z{i}"]
        out.append((z, log(z) - r[f"l{i}"] / z, r[f"hi{i}"] / z, r[f"lo{i}"] / z))
    return out


def solve(shares: DataFrame, total: float, max_repeats: float | None = None, min_entropy: float | None = None,
          cover: bool = True) -> Mix:
    """Bisect the exponent over ``source, tokens, share`` (positive shares).

    With ``cover`` the budget is the least one with which every source is
    passed over at least once; else it is ``total``.  ``max_repeats`` limits the
    passes over any source, ``min_entropy`` (nats) asks for evenness; one of
    them is given.  Each pass over the shares evaluates all points that
    ``HALVINGS`` bisection steps could ask for."""
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("give either max_repeats or min_entropy")

    def meets(found: tuple) -> bool:
        z, entropy, most, least = found
        if min_entropy is not None:
            return entropy >= min_entropy
        return (most / least if cover else most) <= max_repeats * (1 + 1e-12)

    # Entropy holds at 0 and may fail at 1; the repeat limit the other way round.
    lo, hi = 0.0, 1.0
    at_lo, at_hi = _evaluate(shares, [lo, hi])
    good_low = min_entropy is not None
    if meets(at_hi if good_low else at_lo):
        best = hi if good_low else lo
    elif not meets(at_lo if good_low else at_hi):
        best = lo if good_low else hi
    else:
        for _ in range(PASSES):
            step = (hi - lo) / 2 ** HALVINGS
            grid = [lo + step * i for i in range(1, 2 ** HALVINGS)]
            holds = [meets(f) for f in _evaluate(shares, grid)]
            inside = sum(holds) if good_low else len(holds) - sum(holds)
            lo, hi = lo + step * inside, lo + step * (inside + 1)
        best = lo if good_low else hi
    z, _, _, least = _evaluate(shares, [best])[0]
    return Mix(best, total / least if cover else total, 1 / z)


def source_shares(rows: DataFrame) -> tuple[DataFrame, float]:
    """``source, tokens, share`` of the sources that have tokens, and all tokens."""
    sums = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "sources")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), float(total)


def mixed(rows: DataFrame, block_tokens: int, max_repeats: float | None = None, min_entropy: float | None = None,
          cover: bool = True, seed: int = 17) -> DataFrame:
    """Copies of ``_row, source, tokens`` in a mixed order: adds ``weight``,
    ``pass_no`` (from 0), ``block`` and ``slot`` (from 0 within the block).

    A source's budget is its weight times the whole budget; its last pass is
    cut where the budget ends.  With ``cover``, rows of sources without any
    tokens are passed over once."""
    shares, total = source_shares(rows)
    if total:
        mix = solve(shares.filter("tokens > 0"), total, max_repeats, min_entropy, cover)
        weight = F.when(F.col("tokens") > 0, F.lit(mix.scale) * F.pow("share", F.lit(mix.exponent))).otherwise(F.lit(0.0))
        budget = mix.budget
    else:
        weight, budget = F.lit(0.0), 0.0
    blocks = max(1, int(-(-budget // block_tokens)))
    once = F.lit(1.0 if cover else 0.0)
    plan = (shares.withColumn("weight", weight)
            .withColumn("passes", F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(once))
            # A limit that is met exactly is not to start one more pass.
            .withColumn("passes", F.when(F.abs(F.col("passes") - F.round("passes")) < 1e-9, F.round("passes")).otherwise(F.col("passes")))
            .select("source", F.col("tokens").alias("_all"), "weight", "passes",
                    F.ceil(F.col("rows") / ROWS_PER_RANGE).cast("long").alias("_ranges")))
    copies = rows.join(plan, "source").withColumn("pass_no", F.explode(F.when(
        F.col("passes") > 0, F.sequence(F.lit(0), F.ceil("passes").cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    h = F.xxhash64(F.lit(seed), "pass_no", "_row")
    copies = copies.withColumn("_h", h).withColumn("_range", F.pmod(F.shiftrightunsigned("_h", 20), F.col("_ranges")))
    part = ["source", "pass_no", "_range"]
    sums = copies.groupBy(*part).agg(F.sum("tokens").alias("_t"))
    before = W.partitionBy("source", "pass_no").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*part).orderBy("_h", "_row").rowsBetween(W.unboundedPreceding, -1)
    placed = (copies.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, part)
              .withColumn("_cum", F.col("_base") + F.col("_in"))
              .filter((F.col("pass_no") + 1 <= F.col("passes")) |
                      (F.col("_cum") < (F.col("passes") - F.col("pass_no")) * F.col("_all"))))
    # Where in the whole stream of its source a copy starts, from 0 to 1
    # (copies from sources without tokens anywhere).
    start = F.when(F.col("_all") > 0, (F.col("pass_no") * F.col("_all") + F.col("_cum")) / (F.col("passes") * F.col("_all"))).otherwise(
        F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30)))
    placed = placed.withColumn("block", F.least(F.floor(start * blocks), F.lit(blocks - 1)).cast("long"))
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "_h"), "source", "_row", "pass_no")
    return placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).select(
        "_row", "source", "tokens", "weight", "pass_no", "block", "slot")


def mix_documents(docs: DataFrame, block_tokens: int = 1 << 18, max_repeats: float | None = 2.0,
                  min_entropy: float | None = None, cover: bool = True, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``<id_col>, source, n_tokens, weight, pass_no, block, slot``: one row per
    copy of a document in the mixed stream.

    Tokens are words.  Null text is empty; a null source is the source ''; null
    ids are kept; rows with equal ids or texts are placed one by one; an empty
    table gives no rows; other columns of ``docs`` are not read."""
    light = cut(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                            n_tokens(text_col).alias("tokens"), F.xxhash64(whole_text(text_col)).alias("_th")), "rows")
    rows = light.select(F.struct("_id", "_th").alias("_row"), "source", "tokens")
    out = mixed(rows, block_tokens, max_repeats, min_entropy, cover, seed)
    return out.select(F.col("_row._id").alias(id_col), "source", F.col("tokens").alias("n_tokens"),
                      "weight", "pass_no", "block", "slot")


def repeat_documents(docs: DataFrame, max_repeats: float, block_tokens: int = 1 << 18, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``docs``, all columns, with as many rows of each document as the mixed
    stream has copies, and each at least once.

    Every row is a document of its own, told apart by a number it is given as it
    is read, so null and repeated ids, equal texts and equal rows get the copies
    that their source's weight asks for.  Null text is empty, a null source is
    the source ''; an empty table gives no rows.  The number of a row rests on the
    order of the rows, so ``docs`` is written once and read back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, source = (names[docs.columns.index(c)] for c in (text_col, source_col))
    wide = cut(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "documents")
    rows = wide.select("_row", F.coalesce(F.col(source), F.lit("")).alias("source"), n_tokens(text).alias("tokens"))
    mixed_rows = mixed(cut(rows, "rows"), block_tokens, max_repeats, None, True, seed)
    times = mixed_rows.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    copies = wide.join(times, "_row", "left").withColumn(
        "_n", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("_times", F.lit(1)), F.lit(1)))))
    return copies.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

"""Document fingerprints by winnowing (op 2).

Words are hashed, the hashes are rolled into k-grams, and from every window of
``w`` successive k-grams the smallest is kept, the rightmost of equals.  Any
run of ``w + k - 1`` words that two texts share therefore leaves a common
fingerprint in both; positions are kept so that matches can be placed.

All of it is array expressions inside one projection chain: a k-gram hash is
combined from the hashes of two shorter grams, and a window's minimum from the
minima of two shorter windows, so a step costs one pass over the array however
long ``k`` and ``w`` are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlight.llm.common import whole_text, words_of

# A position takes the low bits of a packed value, the hash the bits above.
POSITION_BITS = 28
MAX_BUCKETS = 65_536
QUANTILES = 256


def _zip(col: str, by: int, merge) -> Column:
    """merge(x[i], x[i + by]) for every i that has both."""
    n = F.greatest(F.size(col) - by, F.lit(0))
    return F.zip_with(F.slice(col, F.lit(1), n), F.slice(col, F.lit(1 + by), n), merge)


def winnow(df: DataFrame, text_col: str | Column, out: str, k: int = 4, w: int = 8) -> DataFrame:
    """Add ``out``: array<struct<hash long, pos int>> in order of position.

    Fewer than ``k`` words make one gram of all of them; fewer than ``w``
    grams make one window; null, empty and blank texts have no fingerprint."""
    words, gram, least = f"_{out}_w", f"_{out}_g", f"_{out}_m"
    df = df.withColumn(words, F.transform(words_of(whole_text(text_col)), lambda x: F.xxhash64(x)))
    df = df.withColumn(gram, F.col(words))
    # Left to right over k's bits: double the gram, then add one word if the bit is set.
    size = 1
    for bit in bin(k)[3:]:
        df = df.withColumn(gram, _zip(gram, size, lambda a, b: F.xxhash64(a, b)))
        size *= 2
        if bit == "1":
            have, by = F.size(gram) - 1, size
            df = df.withColumn(gram, F.zip_with(
                F.slice(gram, F.lit(1), F.greatest(have, F.lit(0))),
                F.slice(words, F.lit(1 + by), F.greatest(have, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
            size += 1
    df = df.withColumn(gram, F.when((F.size(gram) == 0) & (F.size(words) > 0),
                                    F.array(F.xxhash64(words))).otherwise(F.col(gram)))
    mask = (1 << POSITION_BITS) - 1
    df = df.withColumn(least, F.transform(
        gram, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(F.lit(mask).cast("long") - i)))
    whole = f"_{out}_a"
    df = df.withColumn(whole, F.array_min(least)).withColumn(f"_{out}_n", F.size(gram))
    size = 1
    while size < w:
        by = min(size, w - size)
        df = df.withColumn(least, _zip(least, by, lambda a, b: F.least(a, b)))
        size += by
    df = df.withColumn(least, F.when(F.col(f"_{out}_n") == 0, F.array().cast("array<bigint>"))
                       .when(F.col(f"_{out}_n") < w, F.array(whole))
                       .otherwise(F.array_distinct(least)))
    pos = lambda x: (F.lit(mask).cast("long") - x.bitwiseAND(F.lit(mask).cast("long"))).cast("int")
    df = df.withColumn(out, F.transform(least, lambda x: F.struct(
        F.get(F.col(gram), pos(x)).alias("hash"), pos(x).alias("pos"))))
    return df.drop(words, gram, least, whole, f"_{out}_n")


def hashes(col: str | Column) -> Column:
    return F.transform(col, lambda x: x["hash"])


def digest(col: str | Column) -> Column:
    """128 bits of the whole fingerprint (hashes and positions), in hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), col)), 16, "0") for seed in (1, 2)]))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Shared share of two sets of hashes; two empty ones are alike."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _id_buckets(docs: DataFrame, key: str, rows_per_bucket: int) -> Column:
    """An expression that maps the ordered key to a bucket number, ascending
    with it: at most 256 quantiles, each cut into equal widths."""
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"),
        F.percentile_approx(key, [i / QUANTILES for i in range(1, QUANTILES)], 20_000).alias("q")).first()
    wanted = min(MAX_BUCKETS, max(1, stats["n"] // rows_per_bucket))
    if wanted == 1:
        return F.lit(0)
    step = max(1, QUANTILES // wanted)
    edges = sorted({stats["lo"], *stats["q"][step - 1::step]})
    subs = max(1, wanted // len(edges))
    lows = F.array(*[F.lit(e).cast("long") for e in edges])
    highs = F.array(*[F.lit(e).cast("long") for e in [*edges[1:], stats["hi"] + 1]])
    k = F.col(key)
    part = F.greatest(F.size(F.filter(lows, lambda e: e <= k)), F.lit(1))
    lo, hi = (F.element_at(a, part).cast("double") for a in (lows, highs))
    within = F.floor((k.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * subs)
    return ((part - 1) * subs + F.least(F.greatest(within, F.lit(0)), F.lit(subs - 1))).cast("int")


def with_next(docs: DataFrame, key: str, payload: list[str], rows_per_bucket: int = 2_000) -> DataFrame:
    """Add ``next_<c>`` for each payload column: the row that follows in
    ascending ``key`` (ties by the first payload column), the first row after
    the last.  One shuffle by key range; the first row of each range is also
    sent to the range before it.  The range table has at most 65,536 rows."""
    bucket = _id_buckets(docs, key, rows_per_bucket)
    rows = docs.withColumn("_b", bucket)
    firsts = rows.select("_b", key).groupBy("_b").agg(F.min(key).alias("_first"))
    chain = W.orderBy("_b")
    last = firsts.agg(F.max("_b").alias("_last"))
    firsts = (firsts.withColumn("_prev", F.lag("_b").over(chain)).crossJoin(F.broadcast(last))
              .select("_b", "_first", F.coalesce("_prev", "_last").alias("_prev")))
    here = F.struct(F.col("_b").alias("b"), F.lit(0).alias("extra"))
    there = F.struct(F.col("_prev").alias("b"), F.lit(1).alias("extra"))
    rows = (rows.join(F.broadcast(firsts), "_b")
            .withColumn("_to", F.explode(F.when(F.col(key) == F.col("_first"), F.array(here, there))
                                         .otherwise(F.array(here))))
            .select(*docs.columns, F.col("_to.b").alias("_at"), F.col("_to.extra").alias("_extra")))
    order = W.partitionBy("_at").orderBy("_extra", key, payload[0])
    return (rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload})
            .filter("_extra = 0").drop("_at", "_extra"))


def fingerprint_edits(docs: DataFrame, k: int = 4, w: int = 8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the same text with its second half
    replaced by the start of the next document, and how alike they are.

    Returns ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_prints``.  Null text is empty; a null id sorts
    first; equal ids are ordered by text; a lone row follows itself; an empty
    table gives no rows; other columns of ``docs`` are not read."""
    lowest = -(1 << 63)
    base = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("_key"))
    # The ids alone decide the ranges; the fingerprint travels with its text.
    own = winnow(base, "_text", "_fp", k, w)
    own = own.select("_id", "_key", "_text", hashes("_fp").alias("_own"), digest("_fp").alias("fingerprint"))
    paired = with_next(own, "_key", ["_text", "_own"])
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    paired = paired.withColumn("_edited", F.concat(
        F.substring("_text", F.lit(1), (n - half)), F.substring("next__text", F.lit(1), half)))
    both = winnow(paired, "_edited", "_efp", k, w)
    return both.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint",
        digest("_efp").alias("edited_fingerprint"),
        likeness(F.col("_own"), hashes("_efp")).alias("near_edited"),
        likeness("_own", "next__own").alias("near_next"),
        F.size("_own").alias("n_prints"))

"""Sharding by a Hilbert curve over several metadata dimensions (op 10).

Every row gets small integer coordinates, rows are ordered along the Hilbert
curve through the grid, and the order is cut into runs of equal row counts, so
that a shard covers a compact box of every dimension and readers can skip
whole files on any of them.  Cells are cut by row counts and keep the order of
the values: a number by its quantiles, a category by its place among the sorted
categories, so that the least and greatest value of a shard say something.

Ranks are found without a global sort: rows fall into (cell, text bucket, id
bucket) groups, whose counts are summed up in three windows (cells along the
curve, text buckets within a cell, id buckets within those), and only the rank
inside a group is a window over rows.  A cell, a text or a source that holds a
third of all rows is spread over as many groups as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlight.llm.common import cut, whole_text

TEXT_BUCKETS = 64


def quantile_cells(docs: DataFrame, value: Column, bits: int) -> Column:
    """Cells of about equally many rows of a number, in its order; null counts
    as the least.  The cuts, 2**bits - 1 numbers, come from one aggregate; a
    value that more rows have than a cell holds takes the place of several cuts
    and leaves the cells between them empty."""
    cells = 1 << bits
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = docs.select(value.cast("double").alias("v")).agg(F.percentile_approx("v", shares, F.lit(100 * cells))).first()[0] or []
    out = F.lit(0)
    for cut_at in cuts:
        out = out + F.when(value > F.lit(cut_at), 1).otherwise(0)
    return out


def with_category_cells(docs: DataFrame, value: Column, bits: int, out: str) -> DataFrame:
    """``docs`` with the cell of a category in ``out``: categories in sorted
    order (null and empty first), cut by row counts.  Categories are counted and
    joined back, so there may be any number of them."""
    key = F.coalesce(value.cast("string"), F.lit(""))
    docs = docs.withColumn(f"{out}_key", key)
    counts = cut(docs.groupBy(f"{out}_key").agg(F.count(F.lit(1)).alias("_n")), "categories")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    before = W.orderBy(f"{out}_key").rowsBetween(W.unboundedPreceding, -1)
    cells = counts.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        f"{out}_key", F.expr(f"_b * {1 << bits} div {max(total, 1)}").cast("int").alias(out))
    return docs.join(cells, f"{out}_key", "left").drop(f"{out}_key")


def hilbert_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Add the Hilbert index of integer coordinates in [0, 2**bits).

    The curve is walked from the highest bit down: each level's orientation is
    undone by an exchange or an inversion of the lower bits, then the axes are
    Gray-coded and their bits interleaved.  Every step is one projection."""
    axes = [f"_h{i}" for i in range(len(coords))]
    df = df.withColumns({a: F.col(c).cast("long") for a, c in zip(axes, coords)})
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1).cast("long")
        for axis in axes:
            is_set = F.col(axis).bitwiseAND(F.lit(1 << level)) != 0
            swap = F.col(axes[0]).bitwiseXOR(F.col(axis)).bitwiseAND(low)
            if axis == axes[0]:
                df = df.withColumn(axis, F.when(is_set, F.col(axis).bitwiseXOR(low)).otherwise(F.col(axis)))
            else:
                df = df.withColumns({
                    axes[0]: F.col(axes[0]).bitwiseXOR(F.when(is_set, low).otherwise(swap)),
                    axis: F.when(is_set, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap)),
                })
    for before, axis in zip(axes, axes[1:]):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(F.lit(1 << level)) != 0,
                                      F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            bit = F.shiftright(F.col(axis).bitwiseXOR(F.col("_turn")), level).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return df.withColumn(out, index).drop("_turn", *axes)


def hilbert_shards(docs: DataFrame, dims: list[Column], n_shards: int = 16, bits: int = 4,
                   id_col: str = "doc_id", text_col: str = "text",
                   rows_per_group: int = 20_000) -> DataFrame:
    """One row per input row: ``<id_col>, size, text_crc32, hilbert, shard, slot``.

    ``dims`` are integer expressions over ``docs`` in [0, 2**bits).  ``size``
    is the text's UTF-8 bytes plus 1.  Row counts of shards differ by at most
    one; ``slot`` numbers a shard's rows from 0 along the curve.  Null or
    empty text has size 1; a null id is ordered first; rows equal in all of
    these share consecutive ranks; an empty table gives no rows.  Columns of
    ``docs`` other than the id are not returned."""
    text, doc_id = whole_text(text_col), F.col(id_col)
    coords = [f"_q{i}" for i in range(len(dims))]
    light = cut(docs.select(
        doc_id.alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_th"),
        F.xxhash64(doc_id).alias("_ih"), *[d.cast("int").alias(c) for d, c in zip(dims, coords)]), "shard_rows")
    n_rows = light.count()
    spread = max(1, n_rows // rows_per_group)
    light = light.withColumns({
        "_tb": F.pmod("_th", F.lit(TEXT_BUCKETS)).cast("int"),
        "_ib": F.pmod("_ih", F.lit(spread)).cast("int")})
    group = [*coords, "_tb", "_ib"]
    groups = light.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # At most 2**(bits * dims) cells: one small window along the curve.
    cells = hilbert_index(groups.groupBy(*coords).agg(F.sum("_n").alias("_cn")), coords, bits, "hilbert")
    along = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cn").over(along), F.lit(0)))
    texts = groups.groupBy(*coords, "_tb").agg(F.sum("_n").alias("_tn"))
    by_text = W.partitionBy(*coords).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    texts = texts.withColumn("_t", F.coalesce(F.sum("_tn").over(by_text), F.lit(0))).drop("_tn")
    by_id = W.partitionBy(*coords, "_tb").orderBy("_ib").rowsBetween(W.unboundedPreceding, -1)
    groups = (groups.withColumn("_in", F.coalesce(F.sum("_n").over(by_id), F.lit(0)))
              .join(texts, [*coords, "_tb"]).join(F.broadcast(cells), coords)
              .select(*group, "hilbert", (F.col("_before") + F.col("_t") + F.col("_in")).alias("_base")))
    ranked = light.withColumn("_r", F.row_number().over(
        W.partitionBy(*group).orderBy("_th", "_id", "size", "text_crc32")) - 1)
    rank = F.col("_base") + F.col("_r")
    # Run s starts at rank ceil(s * total / n_shards); whole-number division only.
    return (ranked.join(groups, group).withColumn("_rank", rank)
            .withColumn("_shard", F.expr(f"_rank * {n_shards} div {max(n_rows, 1)}"))
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "hilbert",
                    F.col("_shard").cast("int").alias("shard"),
                    F.expr(f"_rank - (_shard * {n_rows} + {n_shards - 1}) div {n_shards}").cast("long").alias("slot")))

"""Connected components and id filters over distributed edge lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import cut, with_code

FILTER_BITS = 26


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round over edges ``u, v``: all neighbours of a node meet in
    one task, sorted, so its smallest one comes first and the others are linked
    to it as they stream by, repeated edges once.  The large half takes every
    edge from both ends, links the larger neighbours, and adds a loop where a
    node has a smaller neighbour beside others, as in a star none has; the small
    half links the smaller neighbours and the node, and hands loops on."""
    def run(batches):
        held = None
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in range(2))
            loops = u[u == v][:1]
            u, v = u[u != v], v[u != v]
            ends, tops = u[:0], v[:0]
            if len(u):
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                least, fresh = v[first], np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
                if held is not None and held[0] == u[0]:
                    least[0], fresh[0] = held[2], held[1] != v[0]
                held = (u[-1], v[-1], least[-1])
                least = np.repeat(least, np.diff(np.append(first, len(u))))
                if large:
                    loops = u[(least < u) & (v != least)][:1]
                    found = fresh & (v > u)
                    ends, tops = v[found], np.minimum(u, least)[found]
                else:
                    ends, tops = np.where(v == least, u, v)[fresh], least[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ends, loops])), pa.array(np.concatenate([tops, loops]))],
                                             names=["u", "v"])

    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    rows = edges.select(both).select("e.u", "e.v") if large else edges
    return with_code(rows).repartition("u").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edge list ``a, b`` (long ids), with
    the smallest id of its component as root.

    Alternating large-star and small-star rounds: every node's larger, then
    smaller, neighbours are linked to its smallest one, until all components
    are stars.  A round is two shuffles without joins, so the driver has few
    jobs, plans and broadcasts to keep; its edges are written to the shared
    folder.  Null ids and loops are left out."""
    e = (edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
         .filter("u is not null and v is not null and u <> v").distinct())
    for _ in range(most_rounds):
        found = cut(_stars(_stars(e, True), False), "stars")
        e = found.filter("u <> v")
        if found.filter("u = v").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A bit table of the ids' hashes (8 MB whatever their number), for passing
    over rows that a later join would drop.  False hits are possible."""
    words = (ids.select(slot_of(col).alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")))
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = words.toArrow()
    table[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots (``pmod(xxhash64(id), 2**FILTER_BITS)``) are set."""
    slots = slots.astype(np.int64)
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) != 0


def slot_of(col: str):
    return F.pmod(F.xxhash64(col), F.lit(1 << FILTER_BITS))


def reach(docs: DataFrame, rows: DataFrame, key: str, inside: bool) -> DataFrame:
    """Documents whose id may be (or surely is not) among the rows' ids, told by a bit table."""
    table = id_filter(rows, key)

    def run(batches):
        for batch in batches:
            keep = passes(table, batch.column(batch.num_columns - 1).to_numpy())
            yield batch.filter(pa.array(keep if inside else ~keep))

    wide = with_code(docs).withColumn("_slot", slot_of(key))
    return wide.mapInArrow(run, wide.schema).drop("_slot")

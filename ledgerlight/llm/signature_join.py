"""Exact Jaccard join of word n-gram sets with signature trees (op 7).

1. Every text becomes a set of shingle hashes.  Texts with equal sets form one
   class, represented by its smallest id.
2. Two sets that reach the threshold share a shingle among the first few of each
   in any one order of all shingles (prefix filter).  The order is: a hashed part
   of the shingles, rarest first; the others, by hash; and last those that a
   bounded sample of documents knows as frequent.  The part is large enough to
   fill the prefix of all but the shortest texts, so only its shingles are
   counted, exactly, over all classes: most occur once, and such a shingle takes
   a place in the prefix but leads to no partner.  Under each shingle that is
   left, classes that follow each other by size are linked if their sizes are
   near enough, and what is linked makes a candidate block.
3. Blocks are joined exactly by signature trees: nodes hold the OR of their
   members' bitmaps and their size range, and a dual traversal leaves out node
   pairs whose largest possible overlap is too small.  A block too large for
   one task is first cut into chunks by size and hash, and chunk pairs whose
   size ranges can meet are joined one by one.
4. Links are merged into components.  Where links are counted, every pair that
   the trees leave is verified, and a task gives a class its number of links;
   otherwise pairs that earlier links connect are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlight.llm.common import LOWER_BYTES, cut, whole_text, with_code
from ledgerlight.llm.graph import components, reach

# Documents sampled to find frequent shingles, and frequent shingles kept.
SAMPLE_DOCS, MAX_FREQUENT = 20_000, 200_000
# Counted shingles, as a multiple of those that a prefix takes.
COUNTED = 1.6
# Sets and shingles (of 8 bytes) that one side of a tree join holds, about.
CHUNK_SETS, CHUNK_SHINGLES = 1_000, 20_000_000
MEMO_WORDS, LEAF, HELD_LINKS = 500_000, 16, 1_000_000
# Cells of a table of sets by shingles that is multiplied out at a time.
DENSE = 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct shingle hashes of a text; equal in every task."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        if not words:
            return np.empty(0, np.int64)
        memo = self.memo
        codes = list(map(memo.get, words))
        if None in codes:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for i, word in enumerate(words):
                if codes[i] is None:
                    codes[i] = memo[word] = xxhash.xxh3_64_intdigest(word)
        ids = np.array(codes, np.uint64)
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        grams = ids[:n].copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                grams ^= grams >> np.uint64(31)
                grams = grams * ODD + ids[k:n + k]
            grams ^= grams >> np.uint64(29)
            grams = grams * ODD + np.uint64(width)
        return np.unique(grams.view(np.int64))


def identity(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    data = grams.tobytes()
    whole = xxhash.xxh3_128_intdigest(data)
    low, high = whole & (2**64 - 1), whole >> 64
    return low - 2**64 if low >= 2**63 else low, high - 2**64 if high >= 2**63 else high


def prefix_size(n: int, percent: int) -> int:
    """How many of the first shingles of a set of ``n`` any partner shares one of."""
    return min(n, n - -(-percent * n // 100) + 1)


def head(grams: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counted shingles of a set, and the further ones of its prefix where
    those are too few, in the order that all sets have in common."""
    known = np.zeros(len(grams), np.int64)
    if len(frequent) and len(grams):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        known = np.where(frequent[at] == grams, counts[at], 0)
    part = (grams & 0xFFFFFFFF) < int(min(1.0, COUNTED * (1 - percent / 100)) * 2**32)
    counted = grams[part & (known == 0)]
    more = prefix_size(len(grams), percent) - len(counted)
    if more <= 0:
        return counted, grams[:0]
    rest = ~part | (known > 0)
    return counted, grams[rest][np.lexsort((grams[rest], known[rest]))[:more]]


def frequent_shingles(docs: DataFrame, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several documents of a hashed sample, with their counts."""
    every = max(1, -(-n_docs // SAMPLE_DOCS))

    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t) for t in batch.column(0).to_pylist()]
            grams, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n, pa.int64())], names=["g", "n"])

    found = (docs.filter(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).select("_text").mapInArrow(run, "g long, n long")
             .groupBy("g").agg(F.sum("n").alias("n")).filter("n >= 3")
             .orderBy(F.desc("n"), "g").limit(MAX_FREQUENT).toArrow())
    grams, n = found["g"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def signatures(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``_id, n, s1, s2, have, head, extra``: size and identity of every set, how
    many counted shingles it has, those, and the others of its prefix."""
    def lists(arrays):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))

    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingle(text)
                counted, extra = head(grams, percent, frequent, counts)
                out.append((doc_id, len(grams), *identity(grams), len(counted), counted, extra))
            *numbers, heads, extras = zip(*out)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in numbers], lists(heads), lists(extras)],
                                             names=["_id", "n", "s1", "s2", "have", "head", "extra"])

    return docs.select("_id", "_text").mapInArrow(
        run, "_id long, n long, s1 long, s2 long, have long, head array<long>, extra array<long>")


def prefix_keys(sigs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``key, n, _id``: the prefix shingles of each class that may occur in
    another.  Each counted shingle goes to one task with its ids alone; one that
    many classes have is among the frequent ones, which are not counted."""
    reps = sigs.join(classes.select(F.col("rep").alias("_id")), "_id", "left_semi")
    seen = reps.select("_id", F.explode("head").alias("g")).withColumn("df", F.count(F.lit(1)).over(W.partitionBy("g")))
    shared = seen.filter("df > 1").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared"))
    light = sigs.select("_id", "n", "have")
    # Of the prefix, those that occur once come first and lead nowhere.
    size = F.expr(f"least(n, n - ({percent} * n + 99) div 100 + 1)")
    left = F.least(size, F.col("have")) - (F.col("have") - F.size("shared"))
    keys = shared.join(light, "_id").select(
        "_id", "n", F.explode(F.slice("shared", 1, F.greatest(left, F.lit(0)).cast("int"))).alias("k"))
    extras = reps.filter(F.size("extra") > 0).select(F.explode("extra").alias("key"), "n", "_id")
    return keys.select(F.col("k.g").alias("key"), "n", "_id").unionByName(extras)


def like_sized(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between ids that follow each other by size under one key
    and are of like enough size.  Two sets that could reach the threshold have
    only such steps between them, so they end in one block."""
    def run(batches):
        last = None
        held: list[np.ndarray] = []
        size = 0

        def flush():
            pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, rep = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                key, n, rep = (np.concatenate([[x], c]) for x, c in zip(last, (key, n, rep)))
            last = (key[-1], n[-1], rep[-1])
            step = (key[1:] == key[:-1]) & (rep[1:] != rep[:-1]) & (100 * n[:-1] >= percent * n[1:])
            found = np.column_stack([np.minimum(rep[:-1], rep[1:])[step], np.maximum(rep[:-1], rep[1:])[step]])
            held.append(np.unique(found, axis=0))
            size += len(held[-1])
            if size > HELD_LINKS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return (rows.select("key", "n", "_id").repartition("key").sortWithinPartitions("key", "n", "_id")
            .mapInArrow(run, "a long, b long"))


class SignatureTree:
    """A binary tree over sets sorted by size."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, bits: int):
        self.members = members
        rows = np.zeros((len(members), bits // 8), np.uint8)
        for i, m in enumerate(members):
            flags = np.zeros(bits, bool)
            flags[sets[m] & (bits - 1)] = True
            rows[i] = np.packbits(flags)
        self.rows = rows.view(np.uint64)
        self.sizes = np.array([len(sets[m]) for m in members], np.int64)
        # Shingles beyond the first on their bit: they may match unseen.
        self.surplus = self.sizes - np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64)
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(members))

    def _build(self, lo: int, hi: int) -> int:
        kids = None
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            kids = (self._build(lo, mid), self._build(mid, hi))
            union = self.nodes[kids[0]][0] | self.nodes[kids[1]][0]
        else:
            union = np.bitwise_or.reduce(self.rows[lo:hi], axis=0)
        self.nodes.append((union, int(self.sizes[lo]), int(self.sizes[hi - 1]), int(self.surplus[lo:hi].max()), lo, hi, kids))
        return len(self.nodes) - 1


def needed(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a set on the left with one on the right."""
    both = left + right
    grams, at = np.unique(np.concatenate(both), return_inverse=True)
    if len(both) * len(grams) > DENSE:
        return np.array([[overlap(a, b) for b in right] for a in left], np.int64)
    flags = np.zeros((len(both), len(grams)), np.float32)
    flags[np.repeat(np.arange(len(both)), list(map(len, both))), at] = 1
    return (flags[:len(left)] @ flags[len(left):].T).astype(np.int64)


def tree_join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, every: bool = False):
    """Pairs (i, j) of set numbers whose Jaccard likeness reaches the threshold;
    unless ``every`` one is asked for, without those that links already found
    connect.  ``left`` and ``right`` list the set numbers of either side by
    size; no right side joins the left with itself."""
    bits = 256
    longest = max(len(s) for s in sets)
    while bits < 2 * longest and bits < 16_384:
        bits *= 2
    ltree = SignatureTree(sets, left, bits)
    rtree = ltree if right is None else SignatureTree(sets, right, bits)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    todo = [(ltree.root, rtree.root)]
    while todo:
        u, v = todo.pop()
        ou, lo_u, hi_u, su, u0, u1, ku = ltree.nodes[u]
        ov, lo_v, hi_v, sv, v0, v1, kv = rtree.nodes[v]
        if percent * max(lo_u, lo_v) > 100 * min(hi_u, hi_v):
            continue
        if not (right is None and u == v):
            most = int(np.bitwise_count(ou & ov).sum(dtype=np.int64)) + min(su, sv)
            if most < needed(lo_u, lo_v, percent):
                continue
        if ku or kv:
            if right is None and u == v:
                todo += [(ku[0], ku[0]), (ku[1], ku[1]), (ku[0], ku[1])]
            elif ku and (not kv or u1 - u0 >= v1 - v0):
                todo += [(ku[0], v), (ku[1], v)]
            else:
                todo += [(u, kv[0]), (u, kv[1])]
            continue
        meet = np.bitwise_count(ltree.rows[u0:u1, None, :] & rtree.rows[None, v0:v1, :]).sum(axis=2, dtype=np.int64)
        meet += np.minimum(ltree.surplus[u0:u1, None], rtree.surplus[None, v0:v1])
        hopeful = meet >= needed(ltree.sizes[u0:u1, None], rtree.sizes[None, v0:v1], percent)
        if right is None and u == v:
            hopeful = np.triu(hopeful, 1)
        if every:
            i, j = np.nonzero(hopeful)
            if len(i):
                us, vs = np.unique(i), np.unique(j)
                met = overlaps([sets[m] for m in ltree.members[u0 + us]], [sets[m] for m in rtree.members[v0 + vs]])
                met = met[np.searchsorted(us, i), np.searchsorted(vs, j)]
                linked = met >= needed(ltree.sizes[u0 + i], rtree.sizes[v0 + j], percent)
                yield from zip(ltree.members[u0 + i[linked]].tolist(), rtree.members[v0 + j[linked]].tolist())
            continue
        for i, j in zip(*np.nonzero(hopeful)):
            a, b = int(ltree.members[u0 + i]), int(rtree.members[v0 + j])
            ra, rb = root(a), root(b)
            if ra != rb and overlap(sets[a], sets[b]) >= needed(len(sets[a]), len(sets[b]), percent):
                parent[rb] = ra
                yield a, b


def join_blocks(rows: DataFrame, width: int, percent: int, every: bool = False) -> DataFrame:
    """``a, b, n`` within blocks: rows ``block, side, _id, _text``, blocks in
    runs.  Links that join a block's components have no ``n``; if ``every`` link
    is asked for, a row with a = b gives the number of those of one id."""
    def links(ids, sides, sets):
        order = np.array(sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i])), np.int64)
        sides = np.array(sides)
        if (sides == 0).all():
            found = tree_join(sets, order, None, percent, every)
        else:
            left, right = order[sides[order] == 1], order[sides[order] == 2]
            found = tree_join(sets, left, right, percent, every) if len(left) and len(right) else ()
        if not every:
            return [(ids[a], ids[b], None) for a, b in found]
        number, parent, out = [0] * len(ids), list(range(len(ids))), []
        for a, b in found:
            number[a] += 1
            number[b] += 1
            ra, rb = a, b
            while parent[ra] != ra:
                parent[ra] = ra = parent[parent[ra]]
            while parent[rb] != rb:
                parent[rb] = rb = parent[parent[rb]]
            if ra != rb:
                parent[rb] = ra
                out.append((ids[a], ids[b], None))
        return out + [(i, i, n) for i, n in zip(ids, number) if n]

    def run(batches):
        shingle = Shingler(width)
        held, ids, sides, sets = None, [], [], []

        def flush():
            out = links(ids, sides, sets) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))],
                                              names=["a", "b", "n"])

        for batch in batches:
            for block, side, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if block != held:
                    if len(ids) > 1:
                        yield flush()
                    held, ids, sides, sets = block, [], [], []
                ids.append(doc_id)
                sides.append(side)
                sets.append(shingle(text))
        if len(ids) > 1:
            yield flush()

    return rows.select("block", "side", "_id", "_text").mapInArrow(run, "a long, b long, n long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with its columns named c0, c1, .. and a row id ``_rid``, and
    whether that is the id itself.  Where ids are null or repeated, the rows are
    written in order of id (nulls last) and text hash and numbered."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = F.col(names[docs.columns.index(id_col)]).cast("long")
    wide = with_code(docs).toDF(*names)
    tally = wide.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("ids")).first()
    if tally["n"] == tally["ids"] == wide.select(key).distinct().count():
        return wide.withColumn("_rid", key), True
    text = whole_text(names[docs.columns.index(text_col)])
    ordered = wide.orderBy(key.asc_nulls_last(), F.xxhash64(text))
    return cut(ordered.withColumn("_rid", F.monotonically_increasing_id()), "numbered"), False


def linked(base: DataFrame, width: int, percent: int, every: bool = False) -> DataFrame:
    """``_id, n, root`` of every row ``_id, _text``; ids are distinct.  With
    ``every`` also ``links``, how many other classes its class is linked to."""
    frequent, counts = frequent_shingles(base, width, base.count())
    sigs = cut(signatures(base, width, percent, frequent, counts), "signatures")
    classes = cut(sigs.filter("n > 0").groupBy("s1", "s2").agg(
        F.min("_id").alias("rep"), F.first("n").alias("n")), "classes")
    edges = like_sized(prefix_keys(sigs, classes, percent), percent)
    blocks = cut(components(edges), "blocks")
    members = cut(blocks.join(classes.select(F.col("rep").alias("node"), "n"), "node"), "members")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long")
    totals = members.groupBy("root").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("sets"),
                                         F.min(band).alias("low"), F.max(band).alias("high"))
    chunks = F.greatest(F.ceil(F.col("all") / CHUNK_SHINGLES), F.ceil(F.col("sets") / CHUNK_SETS)).cast("long")
    placed = members.join(totals, "root").withColumn("chunks", chunks)
    whole = F.array(F.struct(F.xxhash64("root").alias("block"), F.lit(0).alias("side"), F.col("root").alias("r")))
    # Of a large block: chunk (band, h) meets (band, h2) and (band + 1, h2).
    h = F.pmod(F.xxhash64("node"), F.col("chunks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)

    def pair(b1, h1, b2, h2, side):
        return F.struct(F.xxhash64("root", b1, h1, b2, h2).alias("block"), side.alias("side"), F.col("root").alias("r"))

    parts = F.concat(
        F.transform(others, lambda o: F.when(o < F.col("_h"), pair(F.col("_b"), o, F.col("_b"), F.col("_h"), F.lit(2)))
                    .otherwise(pair(F.col("_b"), F.col("_h"), F.col("_b"), o, F.when(o == F.col("_h"), F.lit(0)).otherwise(F.lit(1))))),
        # Next bands, where the block has any.
        F.filter(F.transform(others, lambda o: F.when(F.col("_b") < F.col("high"), pair(F.col("_b"), F.col("_h"), F.col("_b") + 1, o, F.lit(1)))), lambda x: x.isNotNull()),
        F.filter(F.transform(others, lambda o: F.when(F.col("_b") > F.col("low"), pair(F.col("_b") - 1, o, F.col("_b"), F.col("_h"), F.lit(2)))), lambda x: x.isNotNull()))
    placed = placed.withColumns({"_b": band, "_h": h}).select(
        F.col("node").alias("_id"), F.explode(F.when(F.col("chunks") <= 1, whole).otherwise(parts)).alias("p"))
    # Texts are moved, not sets: they are shorter, and shingled where they meet.
    texts = reach(base, members.select(F.col("node").alias("_id")), "_id", True)
    rows = (placed.join(texts, "_id")
            .select(F.col("p.block").alias("block"), F.col("p.side").alias("side"), "_id", "_text"))
    links = cut(join_blocks(rows.repartition("block").sortWithinPartitions("block"), width, percent, every), "links")
    groups = components(links.filter("a <> b"))
    named = classes.join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left")
    if every:
        number = links.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        named = named.join(number, "rep", "left")
    found = ["links"] if every else []
    named = named.select("s1", "s2", F.coalesce("root", "rep").alias("root"), *found)
    out = sigs.select("_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return out.select("_id", "n", F.coalesce("root", "_id").alias("root"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in found])



def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``<id_col>, n_shingles, component_id, n_links`` of every document.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; a component's id is its smallest document id.  ``n_links`` is
    the number of other shingle sets that the document's own is linked to,
    however many documents have them.  Texts of fewer
    than ``width`` words have one shingle, all of them; null, empty and blank
    texts have none and stand alone.  Every row is a document of its own, also
    if its id is null or repeated; a component's id is null if none of its rows
    has one; an empty table gives no rows; other columns of ``docs`` are not
    read."""
    rows, own = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    out = linked(rows.select(F.col("_rid").alias("_id"), whole_text("c1").alias("_text")), width, percent, True)
    if not own:
        ids = rows.select("_rid", F.col("c0").cast("long").alias("c0"))
        out = (out.join(ids.toDF("_id", "own"), "_id").join(ids.toDF("root", "first"), "root")
               .drop("_id", "root").withColumnsRenamed({"own": "_id", "first": "root"}))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"),
                      F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, cut down to one row of every group of near
    copies, that with the smallest id (an id before none).  Rows are told apart
    by their texts alone: a null or repeated id costs no row its place."""
    rows, _ = numbered(docs, id_col, text_col)
    text = whole_text(rows.columns[docs.columns.index(text_col)])
    firsts = linked(rows.select(F.col("_rid").alias("_id"), text.alias("_text")), width, percent).filter("_id = root")
    kept = rows.join(firsts.select(F.col("_id").alias("_rid")), "_rid", "left_semi")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(rows.columns, docs.columns)])

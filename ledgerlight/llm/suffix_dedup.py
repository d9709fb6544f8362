"""Removal of repeated passages by external induced sorting (op 5).

Every byte covered by a ``length``-byte string that also starts earlier (in a
document with a smaller id, or earlier in the same one) is removed.

A sort of all suffixes would move many times the input, so only suffixes that
can matter are carried:

1. Sampling.  In every window of ``length`` bytes the k-byte string with the
   smallest hash is its anchor; equal windows have equal anchors at the same
   place.  Successive windows with one anchor form a block.  A task first keeps
   one row for equal blocks of its own texts; the rows are then put in order of
   (anchor, block) by Spark's external sort, and read as a stream: equal blocks
   but the first are repeats, and blocks whose anchor also occurs in a different
   block go on.
2. Induction.  The suffixes that start at these anchors are sorted, with their
   common-prefix lengths.  From them the suffixes that start one byte earlier
   are induced by bucketing on that byte, and so on back to the first window of
   each block, so that every step orders suffixes by what is known of their
   successors.  Windows whose common prefix reaches ``length`` are equal; all
   but the first are repeats.  Anchors are dealt to tasks by Spark's sort, which
   spills to disk, and a task holds a bounded run of anchors at a time.
3. Covered spans are merged per document and cut out.

An anchor with too many different blocks for one task is taken window by
window instead: grouped minima over window hashes, which Spark combines before
the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import cut, whole_text, with_code
from ledgerlight.llm.graph import reach

ANCHOR = 32
# Bytes hashed at a time, blocks sorted at a time, and the most blocks of one
# anchor that are sorted together.
CHUNK_BYTES, RUN_BLOCKS, ANCHOR_BLOCKS = 1_000_000, 60_000, 200_000
BASE = 0x5851F42D4C957F2D
MIX = np.uint64(0xFF51AFD7ED558CCD)
POSITION_BITS = 22
BLOCK = "ah long, sh long, rid long, off int, span int, lead int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    up, down = (np.full(n, np.uint64(b % 2**64)) for b in (BASE, pow(BASE, -1, 2**64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * MIX
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


class Blocks:
    """Blocks of windows that share an anchor, for the bytes of some texts."""

    def __init__(self, length: int, anchor: int = ANCHOR):
        self.length, self.anchor = length, min(anchor, length)
        self.up, self.down = _powers(CHUNK_BYTES + 2 * length + 2)
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of the letters' values times powers; a substring's hash
        is the difference of two, brought back to power 0."""
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.letters[data] * self.up[:len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.down[start])

    def windows_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, last window, anchor) of every block, as offsets into
        ``data``, which holds texts that end at ``ends``; none spans two texts."""
        n = len(data) - self.anchor + 1
        sums = self.sums(data)
        with np.errstate(over="ignore"):
            h = mix((sums[self.anchor:] - sums[:n]) * self.down[:n])
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = (h & ~low) | np.arange(n, dtype=np.uint64)
        w, size = self.length - self.anchor + 1, 1
        while size < w:
            by = min(size, w - size)
            least = np.minimum(least[:-by], least[by:])
            size += by
        at = (least & low).astype(np.int64)
        # A window is whole if its text does not end within it.
        starts = np.arange(len(at))
        text = np.searchsorted(ends, starts, side="right")
        whole = starts + self.length <= ends[np.minimum(text, len(ends) - 1)]
        starts, at, text = starts[whole], at[whole], text[whole]
        if not len(starts):
            return (np.empty(0, np.int64),) * 4 + (sums, h)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        return starts[new], starts[last], at[new], text[new], sums, h


def chunks(texts: list[tuple[int, bytes]], length: int):
    """(data, ends, ids, offsets) of pieces of about CHUNK_BYTES; a longer text
    is cut into pieces that overlap by a window less one byte."""
    held, size = [], 0
    for rid, text in texts:
        for at in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
            part = text[at:at + CHUNK_BYTES + length - 1]
            if len(part) < length:
                continue
            if held and size + len(part) > CHUNK_BYTES + length:
                yield held
                held, size = [], 0
            held.append((rid, at, part))
            size += len(part)
    if held:
        yield held


def merge(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each id, overlapping and touching ones joined."""
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    if not len(rid):
        return rid, start, end
    fresh = np.concatenate([[True], rid[1:] != rid[:-1]])
    # Ends are made to rise over ids, so that one running maximum serves all.
    lift = np.cumsum(fresh) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = fresh.copy()
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rid)]]) - 1
    return rid[first], start[first], (reach - lift)[last]


def sampled(docs: DataFrame, length: int) -> DataFrame:
    """Blocks of all texts.  A task's own repeats become rows with span -1:
    ``off`` and ``lead`` are then the covered bytes."""
    def run(batches):
        blocks = Blocks(length)
        for batch in batches:
            texts = [(r, t) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(t) >= length]
            for held in chunks(texts, length):
                data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
                ends = np.cumsum([len(p) for _, _, p in held])
                ids = np.array([r for r, _, _ in held], np.int64)
                shift = np.array([at for _, at, _ in held], np.int64) - np.concatenate([[0], ends[:-1]])
                first, last, at, text, sums, h = blocks.windows_of(data, ends)
                if not len(first):
                    continue
                lead, span = at - first, last - first
                with np.errstate(over="ignore"):
                    sh = mix(blocks.hashes(sums, first, last + length) + (lead * 1024 + span).astype(np.uint64) * MIX).view(np.int64)
                ah, rid, off = h[at].view(np.int64), ids[text], first + shift[text]
                order = np.lexsort((off, rid, sh, ah))
                ah, sh, rid, off, span, lead = (c[order] for c in (ah, sh, rid, off, span, lead))
                again = np.concatenate([[False], (ah[1:] == ah[:-1]) & (sh[1:] == sh[:-1])])
                # The same place of one text, met in two overlapping pieces, is no repeat.
                again[1:] &= (rid[1:] != rid[:-1]) | (off[1:] != off[:-1])
                r, s, e = merge(rid[again], off[again], off[again] + span[again] + length)
                keep = ~again
                key = mix(r.astype(np.uint64)).view(np.int64)
                cols = [np.concatenate(c) for c in (
                    (ah[keep], key), (sh[keep], s), (rid[keep], r), (off[keep], s),
                    (span[keep], np.full(len(r), -1)), (lead[keep], e))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c.astype(np.int32)) for c in cols[3:]],
                    names=["ah", "sh", "rid", "off", "span", "lead"])

    return docs.select("rid", F.encode("_text", "UTF-8").alias("b")).mapInArrow(run, BLOCK)


def matched(rows: DataFrame, length: int) -> DataFrame:
    """From blocks in order of (ah, sh, rid, off): repeats (kind 0, with covered
    bytes in off and lead) and first blocks whose anchor has others (kind 1)."""
    def run(batches):
        held = None          # the only block so far of the last anchor
        last = (None, None, False)  # its ah, sh, and whether it has several blocks
        for batch in batches:
            ah, sh, rid, off, span, lead = (batch.column(i).to_numpy() for i in range(6))
            out = []
            done = span < 0
            out.append((np.zeros(int(done.sum()), np.int8), ah[done], rid[done], off[done], span[done], lead[done]))
            ah, sh, rid, off, span, lead = (c[~done] for c in (ah, sh, rid, off, span, lead))
            if len(ah):
                new_ah = np.concatenate([[ah[0] != last[0]], ah[1:] != ah[:-1]])
                first = new_ah | np.concatenate([[sh[0] != last[1]], sh[1:] != sh[:-1]])
                rep = ~first
                out.append((np.zeros(int(rep.sum()), np.int8), ah[rep], rid[rep], off[rep], span[rep], off[rep] + span[rep] + length))
                cols = [c[first] for c in (ah, rid, off, span, lead)]
                known = last[2]
                if held is not None:
                    cols = [np.concatenate([[h], c]) for h, c in zip(held, cols)]
                _, index, counts = np.unique(cols[0], return_inverse=True, return_counts=True)
                many = counts[index] > 1
                if known:
                    many |= cols[0] == last[0]
                tail = (cols[0] == ah[-1]) if len(cols[0]) else np.zeros(0, bool)
                out.append((np.ones(int(many.sum()), np.int8), *(c[many] for c in cols)))
                several = bool(many[tail].any()) or (known and ah[-1] == last[0])
                single = tail & ~many
                held = tuple(int(c[single][0]) for c in cols) if not several and single.any() else None
                last = (int(ah[-1]), int(sh[-1]), several)
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["kind", "ah", "rid", "off", "span", "lead"])

    return (rows.repartition("ah").sortWithinPartitions("ah", "sh", "rid", "off")
            .mapInArrow(run, "kind byte, ah long, rid long, off int, span int, lead int"))


def induce(anchor: np.ndarray, rid: np.ndarray, off: np.ndarray, span: np.ndarray, lead: np.ndarray,
           content: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Covered spans (rid, start, end) among blocks, by induced sorting.

    Block i has windows off[i] .. off[i] + span[i]; its anchor is at off[i] +
    lead[i]; content[i] holds the bytes of all its windows."""
    n = len(rid)
    order = np.lexsort((off + lead, rid))
    anchor, rid, off, span, lead = (c[order] for c in (anchor, rid, off, span, lead))
    content = [content[i] for i in order]
    steps = int(lead.max()) + 1
    words = -(-length // 8)
    left = np.zeros((n, steps), np.uint8)    # column d: the byte d + 1 before the anchor
    right = np.zeros((n, words * 8), np.uint8)
    for i, text in enumerate(content):
        at = int(lead[i])
        if at:
            left[i, :at] = np.frombuffer(text, np.uint8, at)[::-1]
        tail = text[at:at + length]
        right[i, :len(tail)] = np.frombuffer(tail, np.uint8)
    _, group = np.unique(anchor, return_inverse=True)
    # Suffixes at the anchors: from the last word to the first, each pass keeps
    # the order that the words behind it have given.
    keys = right.view(">u8").astype(np.uint64)
    by_suffix = np.lexsort((*(keys[:, k] for k in range(words - 1, -1, -1)), group))
    ranked = right[by_suffix]
    differ = ranked[1:, :length] != ranked[:-1, :length]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[group[by_suffix][1:] != group[by_suffix][:-1]] = -1
    common = np.concatenate([[-1], common])
    covered = np.zeros((n, int(span.max()) + 1), bool)
    front = group.astype(np.int64)           # rank of (anchor, bytes before it)
    tails = np.empty(n, np.int64)
    for d in range(steps):
        # Windows d bytes before the anchor reach length - d bytes behind it.
        tails[by_suffix] = np.cumsum(common < length - d)
        t = lead - d
        has = np.flatnonzero((t >= 0) & (t <= span))
        if len(has) > 1:
            _, where, again = np.unique(front[has] * (n + 1) + tails[has], return_index=True, return_inverse=True)
            repeat = where[again] != np.arange(len(has))
            covered[has[repeat], t[has[repeat]]] = True
        # One byte to the left: bucket by it, in the order known so far.
        _, front = np.unique(front * 256 + left[:, d], return_inverse=True)
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, s = np.nonzero(edge == 1)
    _, e = np.nonzero(edge == -1)
    return rid[i], off[i] + s, off[i] + e - 1 + length


def sorted_runs(rows: DataFrame, length: int) -> DataFrame:
    """Induced sorting over runs of whole anchors."""
    def run(batches):
        held: list[list] = [[] for _ in range(6)]
        size = 0

        def flush(upto: int):
            cols = [np.concatenate(c) for c in held[:5]]
            texts = held[5]
            r, s, e = induce(*(c[:upto] for c in cols), texts[:upto], length) if upto > 1 else (np.empty(0, np.int64),) * 3
            r, s, e = merge(r, s, e)
            for k in range(5):
                held[k] = [cols[k][upto:]]
            held[5] = texts[upto:]
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                                              names=["rid", "s", "e"])

        for batch in batches:
            for k in range(5):
                held[k].append(batch.column(k).to_numpy().astype(np.int64))
            held[5] = held[5] + batch.column(5).to_pylist()
            size += batch.num_rows
            if size >= RUN_BLOCKS:
                anchors = np.concatenate(held[0])
                upto = int(np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))[-1])
                if upto:
                    yield flush(upto)
                    size -= upto
        if size:
            yield flush(size)

    return rows.mapInArrow(run, "rid long, s long, e long")


def with_content(blocks: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Blocks with their bytes: the texts that hold any are joined to them."""
    texts = reach(docs, blocks, "rid", True).select("rid", F.encode("_text", "UTF-8").alias("b"))
    lists = blocks.groupBy("rid").agg(F.collect_list(F.struct("ah", "off", "span", "lead")).alias("x"))
    at = F.col("p.off")
    return (lists.join(texts, "rid").select("rid", "b", F.explode("x").alias("p"))
            .select(F.col("p.ah").alias("ah"), "rid", at.alias("off"), F.col("p.span").alias("span"),
                    F.col("p.lead").alias("lead"),
                    F.substring("b", at + 1, F.col("p.span") + F.lit(length)).alias("content")))


def window_repeats(blocks: DataFrame, length: int) -> DataFrame:
    """Repeats among all windows of the blocks by grouped minima of window hashes."""
    def run(batches):
        import hashlib
        for batch in batches:
            out = []
            for rid, off, span, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "off", "span", "content"))):
                for t in range(span + 1):
                    out.append((hashlib.blake2b(text[t:t + length], digest_size=16).digest(), rid, off + t))
            cols = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64()))],
                                             names=["w", "rid", "s"])

    windows = cut(blocks.mapInArrow(run, "w binary, rid long, s long"), "windows")
    firsts = windows.groupBy("w").agg(F.min(F.struct("rid", "s")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (windows.join(firsts, "w").filter(F.struct("rid", "s") != F.col("f"))
            .select("rid", "s", (F.col("s") + length).alias("e")))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``rid, s, e``: covered byte spans of documents ``rid, _text``, unmerged."""
    found = cut(matched(sampled(docs, length), length), "blocks")
    known = found.filter("kind = 0").select("rid", F.col("off").cast("long").alias("s"), F.col("lead").cast("long").alias("e"))
    open_blocks = found.filter("kind = 1").select("ah", "rid", "off", "span", "lead")
    sizes = open_blocks.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ANCHOR_BLOCKS).select("ah")
    sizes = cut(sizes, "large_anchors")
    few = open_blocks
    spans = known
    if not sizes.isEmpty():
        few = open_blocks.join(sizes, "ah", "left_anti")
        spans = spans.unionByName(window_repeats(with_content(open_blocks.join(sizes, "ah", "left_semi"), docs, length), length))
    runs = with_content(cut(few, "few") if few is not open_blocks else few, docs, length)
    return spans.unionByName(sorted_runs(runs.repartition("ah").sortWithinPartitions("ah"), length))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   whole_chars: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the id), ``n_bytes, n_removed, spans, kept`` of every document.

    ``spans`` are the removed byte runs [start, end) of the UTF-8 text, in
    order, and ``kept`` the other bytes.  ``whole_chars`` narrows each run to
    whole characters.  Null text is empty; texts shorter than ``length`` keep
    all; null ids come first; rows with equal ids are ordered by a hash of the
    text, and of equal rows all but one are later copies; an empty table gives
    no rows; columns of ``docs`` outside ``keep`` are not read."""
    keep = keep or [id_col]
    base = with_code(docs).select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"),
                                  F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("_keep"))
    tally = base.agg(F.count(F.lit(1)).alias("n"), F.count("_id").alias("ids")).first()
    distinct = base.select("_id").distinct().count()
    if tally["n"] == tally["ids"] == distinct:
        rows = base.withColumn("rid", F.col("_id"))
    else:
        rows = cut(base.orderBy(F.asc_nulls_first("_id"), F.xxhash64("_text")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    spans = cut(repeated_spans(rows.select("rid", "_text"), length), "spans")
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    out = f"_keep {base.schema['_keep'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"

    def run(batches):
        for batch in batches:
            found = []
            for data, x in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                kept, runs = data, []
                if x:
                    s, e = (np.array([p[c] for p in x], np.int64) for c in ("s", "e"))
                    _, s, e = merge(np.zeros(len(s), np.int64), s, e)
                    runs = [(int(a), int(b)) for a, b in zip(s, e)]
                    if whole_chars:
                        runs = [(a, b) for a, b in (narrowed(data, a, b) for a, b in runs) if a < b]
                    ends = [0] + [b for _, b in runs]
                    kept = b"".join(data[a:b] for a, b in zip(ends, [a for a, _ in runs] + [len(data)]))
                found.append((len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in runs], kept))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                                 names=["_keep", "n_bytes", "n_removed", "spans", "kept"])

    bytes_of = F.encode("_text", "UTF-8").alias("b")
    touched = reach(rows, spans, "rid", True).join(lists, "rid", "left").select("_keep", bytes_of, "x").mapInArrow(run, out)
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    intact = reach(rows, spans, "rid", False).select(
        "_keep", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        nothing.alias("spans"), F.encode("_text", "UTF-8").alias("kept"))
    return touched.unionByName(intact).select(
        *[F.col(f"_keep.c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "spans", "kept")


def narrowed(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The run without characters that it covers in part."""
    while start < end and start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end

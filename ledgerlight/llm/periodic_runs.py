"""Periodic runs in texts (op 11): difference-cover LCE and a harmonic grid.

A run is a stretch of words with smallest period q, of at least ``min_words``
words and three periods, that no neighbouring word extends.  A stretch of three
periods holds, for some multiple x of 2q, both word x and word x + q; so for
every q only the pairs of that grid are looked at, n/2q of them, and n log n / 2
in all.  From a pair of equal words the stretch is found by two queries for the
longest common extension (LCE), to the right and, in the reversed text, to the
left.

LCE queries rest on a difference cover: of every 31 positions six are sampled,
such that any two positions reach a pair of samples by one common step of less
than 31 words.  Only sampled suffixes are sorted: blocks of 31 words get names,
the names of each residue class form a reduced string, and prefix doubling sorts
that.  Common prefixes of neighbours in this order go into a sparse table.  A
query compares words up to the samples and takes a range minimum there.

A task works on its texts in bundles, each one array with a symbol of its own
between texts, so that no stretch spans two of them.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlight.llm.common import id_crc, whole_text, with_code, words_of

# A perfect difference set modulo 31.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
# Words of a bundle (a longer text is a bundle of its own), pairs looked at together.
BUNDLE_WORDS, PAIRS = 150_000, 400_000
# Words that a pair must agree on to one side before LCE structures are built.
SCREEN = 8


def common_steps() -> np.ndarray:
    """For residues (i, j) the least step that takes both into the cover."""
    inside = np.isin(np.arange(CYCLE), COVER)
    at = (np.arange(CYCLE)[:, None] + np.arange(CYCLE)) % CYCLE  # residue, step
    return (inside[at][:, None, :] & inside[at][None, :, :]).argmax(axis=2)


STEPS = common_steps()


class Extension:
    """LCE of two suffixes of an array that ends with a symbol found nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, n = symbols, len(symbols)
        places = np.concatenate([np.arange(d, n, CYCLE) for d in COVER])
        padded = np.concatenate([symbols, np.zeros(CYCLE, symbols.dtype)]).astype(">u4")
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, CYCLE)[places])
        # Names in the order of the blocks' words.  A block with a symbol found
        # once has a name found once, so suffixes differ before classes end.
        names = np.unique(blocks.view(f"V{4 * CYCLE}").ravel(), return_inverse=True)[1].astype(np.int64).ravel()
        m, levels, width = len(places), [names], 1
        while m and levels[-1].max() + 1 < m:
            rank = levels[-1]
            behind = np.zeros(m, np.int64)
            behind[:max(0, m - width)] = rank[width:] + 1
            levels.append(np.unique(rank * (m + 1) + behind, return_inverse=True)[1].astype(np.int64).ravel())
            width *= 2
        self.rank = np.full(n, -1, np.int64)
        self.rank[places] = levels[-1]
        order = np.empty(m, np.int64)
        order[levels[-1]] = np.arange(m)
        # Common prefixes of neighbours: whole blocks by the levels, then words.
        a, b = order[:-1].copy(), order[1:].copy()
        equal = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels) - 1)):
            same = levels[k][a] == levels[k][b]
            step = np.where(same, 1 << k, 0)
            equal, a, b = equal + step, a + step, b + step
        words = (blocks[a] != blocks[b]).argmax(axis=1) if len(a) else equal
        table = [(equal * CYCLE + words).astype(np.int32)]
        while 2 ** len(table) <= len(a):
            last, half = table[-1], 2 ** (len(table) - 1)
            table.append(np.minimum(last[:-half], last[half:]))
        self.table = table

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of the prefixes at ``low .. high - 1``."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j`` (different) have in common."""
        step = STEPS[i % CYCLE, j % CYCLE]
        out = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        sampled = []
        for t in range(CYCLE):
            there = step[active] == t
            sampled.append(active[there])
            active = active[~there]
            active = active[self.symbols[i[active] + t] == self.symbols[j[active] + t]]
            out[active] += 1
        at = np.concatenate(sampled)
        r, s = self.rank[i[at] + step[at]], self.rank[j[at] + step[at]]
        out[at] += self.least(np.minimum(r, s), np.maximum(r, s))
        return out


def grid_pairs(symbols: np.ndarray, longest: int):
    """Pairs of equal words ``(x, q)``, x a multiple of 2q, for all periods that
    fit three times into ``longest`` words, some hundred thousand at a time."""
    xs, qs, held = [], [], 0
    for q in range(1, longest // 3 + 1):
        right = symbols[q::2 * q]
        x = np.flatnonzero(symbols[:len(symbols) - q:2 * q][:len(right)] == right)
        if len(x):
            xs.append(x * (2 * q))
            qs.append(np.full(len(x), q))
            held += len(x)
            if held > PAIRS:
                yield np.concatenate(xs), np.concatenate(qs)
                xs, qs, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(qs)


def reaches(symbols: np.ndarray, x: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
    """Whether words x and x + q agree with their next SCREEN - 1 on one side."""
    active = np.arange(len(x))
    for t in range(1, SCREEN):
        a = x[active] + way * t
        active = active[symbols[a] == symbols[a + q[active]]]
    out = np.zeros(len(x), bool)
    out[active] = True
    return out


def joined(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """One array of all texts, a symbol of its own before, between and behind
    them; and where each text starts."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]) + 1
    out = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    out[0] = vocabulary
    for k, (start, text) in enumerate(zip(starts, texts)):
        out[start:start + len(text)] = text
        out[start + len(text)] = vocabulary + k + 1
    return out, starts


def runs_of(texts: list[np.ndarray], vocabulary: int, min_words: int = 24) -> list[list[tuple[int, int, int]]]:
    """For each text (word numbers below ``vocabulary``) its runs ``(start,
    length, period)`` by start, then period.  ``min_words`` is 24 or more: then
    a pair that disagrees within SCREEN words on both sides lies in no run."""
    if min_words < 3 * SCREEN:
        raise ValueError(f"min_words must be {3 * SCREEN} at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = max(map(len, texts), default=0)
    if longest < min_words:
        return out
    symbols, starts = joined(texts, vocabulary)
    # Screen all pairs, then build structures of the texts that still have some.
    hopeful = []
    for x, q in grid_pairs(symbols, longest):
        keep = reaches(symbols, x, q, 1) | reaches(symbols, x, q, -1)
        hopeful.append((x[keep], q[keep]))
    if not sum(len(x) for x, _ in hopeful):
        return out
    x, q = map(np.concatenate, zip(*hopeful))
    # A pair may also lie in two texts, of which one copies the other.
    of = np.searchsorted(starts, x, side="right") - 1
    same = np.searchsorted(starts, x + q, side="right") - 1 == of
    x, q, of = x[same], q[same], of[same]
    kept = np.unique(of)
    if len(kept) < len(texts):
        symbols, new_starts = joined([texts[k] for k in kept], vocabulary)
        place = np.searchsorted(kept, of)
        x = x - starts[of] + new_starts[place]
        starts = new_starts
    n = len(symbols)
    right, left = Extension(symbols), Extension(symbols[::-1])
    found = {}
    for at in range(0, len(x), PAIRS):
        a, p = x[at:at + PAIRS], q[at:at + PAIRS]
        low, high = a - left(n - a, n - a - p), a + p + right(a, a + p)
        long = high - low >= np.maximum(min_words, 3 * p)
        for s, e, period in np.unique(np.stack([low[long], high[long], p[long]], 1), axis=0).tolist():
            # Of the periods of one stretch the smallest counts; others are its multiples.
            found[s, e] = min(period, found.get((s, e), period))
    for (s, e), period in sorted(found.items(), key=lambda f: (f[0][0], f[1])):
        k = int(np.searchsorted(starts, s, side="right")) - 1
        out[kept[k]].append((s - int(starts[k]), e - s, period))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def bundles(texts: list[list[bytes]]):
    """Indices of texts that are worked on together, of like length."""
    held, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if held and size + len(texts[k]) > BUNDLE_WORDS:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(texts[k])
    if held:
        yield held


def find_runs(docs: DataFrame, min_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, runs (array of start, length, period by start, then
    period), collapsed``: the periodic runs of each text and the text without
    the words behind each run's first period, joined by single spaces.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words, no
    runs and an empty ``collapsed``; null and repeated ids are kept, a row for a
    row; an empty table gives no rows; other columns are not read.  A task holds
    one text at a time in full, with some 300 bytes a word of the longest."""
    rows = with_code(docs).select(F.col(id_col), whole_text(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string(
        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary").fields])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.split() for t in batch.column(1).to_pylist()]
            runs: list[list] = [[] for _ in texts]
            for group in bundles(texts):
                if len(texts[group[-1]]) < min_words:
                    continue
                number = {w: i for i, w in enumerate(set().union(*[texts[k] for k in group]))}
                coded = [np.fromiter(map(number.__getitem__, texts[k]), np.int64, len(texts[k])) for k in group]
                for k, found in zip(group, runs_of(coded, len(number), min_words)):
                    runs[k] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], run_type),
                 pa.array([b" ".join(kept_words(t, r)) for t, r in zip(texts, runs)], pa.binary())],
                names=[id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which every tenth text, by the crc32 h of its id, is periodic
    from word a on: with g = floor(h / 10), a = g mod n and period p = 1 +
    floor((n - a) / (3 + g mod 8)), word i becomes word a + (i - a) mod p."""
    h = id_crc(id_col)
    g = F.floor(h / 10).cast("long")
    words = F.when(h % 10 == 0, words_of(whole_text(text_col)))
    shaped = docs.withColumns({"_w": words, "_g": g})
    n = F.size("_w").cast("long")
    shaped = shaped.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    shaped = shaped.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)).cast("long"))
    planted = F.concat_ws(" ", F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))))
    return (shaped.withColumn(text_col, F.when(F.col("_a").isNotNull(), planted).otherwise(F.col(text_col)))
            .drop("_w", "_g", "_a", "_p"))


def strongest(runs) -> F.Column:
    """The run of the greatest exact length / period (ties: start, period)."""
    def before(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, before), 0)

"""Language-model scores from a probabilistic suffix tree over words (op 3).

Symbols are the words of the training texts, the end mark, and one symbol for
all words that are not among them.  A context of up to ``depth`` preceding
words becomes a state of the tree if it was seen a few times in training and if
what follows it differs enough from what follows its shorter suffix.  A state's
next-word distribution holds the counts of all successors seen again and is
smoothed towards its suffix's; at the root, counts are discounted by Kneser and
Ney's rule and the discounts go to unseen words.  Every token is scored in the
longest suffix that is a state.

The tree is tables, level by level: words and runs of words are known by 64-bit
hashes (two that share one would share counts), counted over all training
tokens, and met with the level before in joins.  The log-probability of a token
is a sum over the states on its way to the root: the weight that a state leaves
to its suffix, or what a held successor gains over the suffix.  So every run of
words has one value, and a text's score is the sum of the values of its runs.
Values of frequent runs and words (at most 1 / share) are sent to every task.
All others are looked up: a block of texts sends each of its keys once, with the
texts that hold it, to the key's part of the table, which sends back sums by
text.  What is shuffled by the token travels as packed arrays, in which a word is
its rank among the frequent ones if it is one.  The texts are scored in rounds,
each of which frees its shuffles, so that one round's lookups lie on disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.common import LOWER_BYTES, cut, whole_text, with_code
from ledgerlight.llm.graph import FILTER_BITS, passes

# Shares of all training tokens from which on a word or a run of words is sent
# to every task; those below are looked up.  They only move work, not results.
COMMON_SHARE, HOT_SHARE = 1e-6, 1e-6
# Share from which on a word is sent by its rank, and rounds in which texts are
# scored; they only move work, too.
RANKED_SHARE, ROUNDS = 2e-7, 3
# Sightings that make a context a candidate and a successor held.
STATE_COUNT, SUCCESSOR_COUNT = 16, 2
DEPTH, LEAST_DIVERGENCE = 3, 0.01
# Share of all training tokens from which on a context's successors are spread
# over all parts, and training tokens a task of a shuffle (in PARTS_A_TASK parts).
SPREAD_SHARE, TASK_TOKENS, PARTS_A_TASK = 1e-3, 2_000_000, 4
# Bytes and texts hashed at once; keys and texts in a block, at most; texts whose
# sums a task holds before it sends them on.
CHUNK, CHUNK_TEXTS, BLOCK_KEYS, BLOCK_TEXTS, HELD_TEXTS = 2_000_000, 5_000, 2_000_000, 60_000, 1_000_000
# Setting that frees the files of an execution's shuffles when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOWERED = np.frombuffer(LOWER_BYTES, np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256                # bytes beyond which a word is hashed by itself
END = b""                      # as a word; no word is empty
END_CODE = np.uint64(xxhash.xxh3_64_intdigest(END))
PRESS = pa.Codec("zstd", compression_level=1)


def freed(df: DataFrame, name: str) -> DataFrame:
    """``cut``, after which the shuffles that made the table leave the disk."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(FREE_SHUFFLES, before)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, each text after an end mark and the
    last before one, and the tokens (words and end) of every text.  ``data``:
    their bytes, one text after the other; ``offsets``: where they begin and end."""
    size = len(data)
    low = np.zeros(size + 8, np.uint8)
    low[:size] = LOWERED[data]
    solid, edge = ~BLANK[data], np.zeros(size + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:size]
    last[:-1] &= ~solid[1:] | edge[1:size]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    length = ends - starts
    eight = np.ndarray((size + 1,), "<u8", low, strides=(1,))
    h = mixed((eight[starts] & MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * ODD)
    at, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(at):
        h[at] = mixed(h[at] ^ (eight[starts[at] + done] & MASKS[np.minimum(length[at] - done, 8)]))
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i]:ends[i]].tobytes())
    codes = np.full(len(h) + len(words) + 1, END_CODE)
    codes[np.arange(len(h)) + np.repeat(np.arange(1, len(words) + 1), words)] = h
    return codes, words + 1


def coded(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``begin, end, codes, tokens`` of the texts, some at a time (see ``hashed``)."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1
        end = min(max(end, begin + 1), begin + CHUNK_TEXTS, len(texts))
        here = offsets[begin:end + 1]
        yield begin, end, *hashed(data[here[0]:here[-1]], here - here[0])
        begin = end


def token_counts(docs: DataFrame) -> DataFrame:
    """``key, c``: words by their hashes over all texts; the end mark counts once a text."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        def rows():
            keys, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], names=["key", "c"])

        for batch in batches:
            for _, _, codes, _ in coded(batch.column(0)):
                held.append(np.unique(codes[1:], return_counts=True))
                if sum(len(k) for k, _ in held) > BLOCK_KEYS // 2:
                    held = [merged()]
                    if len(held[0][0]) > BLOCK_KEYS // 4:
                        yield rows()
                        held = []
        if held:
            yield rows()

    return docs.select("_text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Root:
    """Discounted unigram law over the words seen and one for all others."""

    tokens: int
    kinds: int
    discounts: tuple[float, float, float]
    unseen: float

    @staticmethod
    def fit(tokens: int, kinds: int, counts_of: dict[int, int]) -> "Root":
        """``counts_of``: how many words were seen exactly 1, 2, 3, 4 times."""
        n1, n2, n3, n4 = (counts_of.get(i, 0) for i in (1, 2, 3, 4))
        if not tokens:
            return Root(0, 0, (0.0, 0.0, 0.0), 1.0)
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
        d = tuple(float(np.clip(v, 0.1, i + 0.9)) for i, v in enumerate(raw))
        taken = d[0] * n1 + d[1] * n2 + d[2] * (kinds - n1 - n2)
        return Root(tokens, kinds, d, taken / tokens)

    def log10(self, c: np.ndarray) -> np.ndarray:
        d = np.select([c == 1, c == 2], self.discounts[:2], self.discounts[2])
        return np.log10(np.maximum(c - d, 1e-300) / max(self.tokens, 1))

    def column(self, c: Column) -> Column:
        d = F.when(c == 1, F.lit(self.discounts[0])).when(c == 2, F.lit(self.discounts[1])).otherwise(F.lit(self.discounts[2]))
        return F.when(c == 0, F.lit(float(np.log10(self.unseen)))).otherwise(F.log10((c - d) / F.lit(float(max(self.tokens, 1)))))


@dataclass
class Tree:
    """The tables of a small corpus as arrays.  ``pairs``: sorted (state, successor)."""

    root: np.ndarray                                   # log10 p of every word
    parent: np.ndarray
    rest: np.ndarray                                   # log10 weight of the suffix
    pairs: np.ndarray
    logp: np.ndarray


def extend(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs of words with one more word."""
    g = (run ^ (run >> np.uint64(31))) * ODD + word
    g = (g ^ (g >> np.uint64(29))) * ODD
    return g ^ (g >> np.uint64(32))


def runs_in(codes: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, .. ``longest`` words: places in ``codes`` where a run of so
    many words ends, and its hash.  No run goes beyond the ends of a text."""
    inside = codes != END_CODE
    at, run = np.arange(len(codes) - 1), codes[:-1]
    out = [(at, run)]
    for m in range(2, longest + 1):
        if m > 2:
            use = inside[at]
            at, run = at[use], run[use]
        run, at = extend(run, codes[at + 1]), at + 1
        out.append((at, run))
    return out


def tasks_for(tokens: int) -> int:
    return 1 + tokens // TASK_TOKENS


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a key; it does not fall as the key grows."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys that are not empty, with their places."""
    part = part_of(keys, parts)
    begin = changes(part)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
        yield int(part[a]), slice(a, b)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted ones in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def guide_of(keys: np.ndarray) -> np.ndarray:
    """Where the hashes that begin with the same bits begin among the sorted keys."""
    bits = len(keys).bit_length() + 1
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def find_by(guide: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``find`` of hashes in any order, from their places in the guide on."""
    if not len(keys):
        return find(keys, wanted)
    last = len(keys) - 1
    at = np.minimum(guide[wanted >> np.uint64(65 - len(guide).bit_length())], last).astype(np.int64)
    on = np.flatnonzero((keys[at] < wanted) & (at < last))
    while len(on):
        at[on] += 1
        on = on[(keys[at[on]] < wanted[on]) & (at[on] < last)]
    return at, keys[at] == wanted


def order_of(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes by their first bits (the 32 of ``part_of`` at least), as
    one sort without an argsort.  Equal hashes may, rarely, stand apart."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    return (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)


def changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])[:len(x)])


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """The first bytes of all numbers, then their second bytes, and so on, compressed:
    those of small numbers are alike.  ``rising`` ones are kept as their steps."""
    if rising:
        x = np.diff(x, prepend=np.zeros(1, x.dtype))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + PRESS.compress(planes, asbytes=True)


def numbers(blob: bytes | None, kind, rising: bool = False) -> np.ndarray:
    """What ``packed`` was given."""
    if not blob:
        return np.empty(0, kind)
    planes = PRESS.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def bit_table(keys: DataFrame) -> np.ndarray:
    """8 MB of bits for passing over keys that a later join would drop; the
    uppermost bits of a key are its place.  False hits are possible."""
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    found = (keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
             .toArrow())
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return passes(table, keys >> np.uint64(64 - FILTER_BITS))


def successor_counts(docs: DataFrame, sent, level: int, tasks: int, least: float) -> DataFrame:
    """``ctx, sfx, w, n, key, shorter``: (context of ``level`` words, next word)
    seen ``least`` times and more, for the contexts that pass the bit table;
    ``sfx`` and ``shorter`` are the hashes of context and run without the oldest
    word.  Tasks send counts by parts of the contexts, packed; successors of the
    most frequent contexts go to parts by themselves.  ``words`` are a context's
    successors, then its words from the last to the second: ranks, and the hashes
    of those without one in ``rare``."""
    parts = tasks * PARTS_A_TASK

    def run(batches):
        bits, spread, ranked, rank_of, _ = sent.value
        guide, spread_guide = guide_of(ranked), guide_of(spread)
        held: list[tuple[np.ndarray, ...]] = []

        def rows():
            ctx, *words = map(np.concatenate, zip(*held))
            held.clear()
            key = extend(ctx, words[0])
            first = order_of(key)
            begin = changes(key[first])
            n, first = np.diff(np.append(begin, len(key))).astype(np.uint32), first[begin]
            ctx, key = ctx[first], key[first]
            route = np.where(find_by(spread_guide, spread, ctx)[1], key, ctx)
            order = order_of(route)
            ctx, n, first = ctx[order], n[order], first[order]
            out = []
            for part, own in split(route[order], parts):
                c = ctx[own]
                begin = changes(c)
                size = np.diff(np.append(begin, len(c))).astype(np.uint32)
                sent_words = np.concatenate([words[0][first[own]], *(w[first[own][begin]] for w in words[1:])])
                at, hit = find_by(guide, ranked, sent_words)
                ranks = np.where(hit, rank_of[at], np.uint32(0)) if len(ranked) else np.zeros(len(at), np.uint32)
                out.append((part, packed(c[begin], True), *map(packed, (size, ranks, sent_words[~hit], n[own]))))
            kinds = (pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                              names=["part", "ctx", "size", "words", "rare", "n"])

        for batch in batches:
            for _, _, codes, _ in coded(batch.column(0)):
                at, ctx = runs_in(codes, level)[-1]
                use = may_hold(bits, ctx)
                if level > 1:
                    use &= codes[at] != END_CODE
                at, ctx = at[use], ctx[use]
                if len(at):
                    held.append((ctx, codes[at + 1], *(codes[at - back] for back in range(level - 1))))
                if sum(len(x[0]) for x in held) > BLOCK_KEYS:
                    yield rows()
        if held:
            yield rows()

    def add(batches):
        word_of = sent.value[-1]
        part, held = None, []

        def rows():
            ctx, sfx, w, n = map(np.concatenate, zip(*held))
            key = extend(ctx, w)
            first = np.argsort(key)
            begin = changes(key[first])
            n = np.add.reduceat(n[first], begin, dtype=np.int64)
            first = first[begin]
            key = key[first]
            use = np.flatnonzero(n >= least)
            use = use[np.argsort(ctx[first[use]], kind="stable")]
            ctx, sfx, w = (c[first[use]] for c in (ctx, sfx, w))
            shorter = w if level == 1 else extend(sfx, w)
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (ctx, sfx, w, n[use], key[use], shorter)],
                                              names=["ctx", "sfx", "w", "n", "key", "shorter"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and held:
                    yield rows()
                    held = []
                part, size = r["part"], numbers(r["size"], np.uint32)
                ranks, n = numbers(r["words"], np.uint32), numbers(r["n"], np.uint32)
                words = word_of[ranks]
                words[ranks == 0] = numbers(r["rare"], np.uint64)
                w, *last = np.split(words, len(n) + len(size) * np.arange(level))[:level]
                sfx = last[-1] if last else np.zeros(len(size), np.uint64)
                for word in last[-2::-1]:
                    sfx = extend(sfx, word)
                held.append((np.repeat(numbers(r["ctx"], np.uint64, True), size), np.repeat(sfx, size), w, n))
        if held:
            yield rows()

    sent_on = docs.select("_text").mapInArrow(run, "part int, ctx binary, size binary, words binary, rare binary, n binary")
    return sent_on.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(
        add, "ctx long, sfx long, w long, n long, key long, shorter long")


def levels(docs: DataFrame, words: DataFrame, root: Root, depth: int, least_state: float, least_successor: float,
           least_divergence: float, named: bool = False) -> list[DataFrame]:
    """The laws of the candidate contexts of 1, 2, .. words, one row a successor:
    ``ctx, n, seen, key, last, head, kept, weight, total, rest, before, logp``, with ``sfx`` and
    ``w`` if ``named``; logarithms to base 10.  ``last``: the successor is the end
    mark.  ``head`` is true in one row of a context.  ``logp`` is the law of the context, or of its longest suffix that is
    kept if it is not kept itself; ``before`` is that of its suffix."""
    spark = docs.sparkSession
    least, again = max(2.0, least_state), max(2.0, least_successor)
    end, tasks = int(END_CODE.view(np.int64)), tasks_for(root.tokens)
    candidates = words.filter(F.col("c") >= least).select("key", F.col("c").alias("seen"))
    before = words.filter(F.col("c") >= again).select(F.col("key").alias("shorter"), root.column(F.col("c")).alias("before"))
    frequent = words.filter(F.col("c") >= max(again, RANKED_SHARE * root.tokens)).toArrow().sort_by([("c", "descending"), ("key", "ascending")])
    word_of = np.concatenate([np.zeros(1, np.uint64), frequent["key"].to_numpy().view(np.uint64)])
    by_key = np.argsort(word_of[1:])
    ranked, rank_of = word_of[1:][by_key], (by_key + 1).astype(np.uint32)
    out: list[DataFrame] = []
    for level in range(1, depth + 1):
        spread = candidates.filter(F.col("seen") >= max(1.0, SPREAD_SHARE * root.tokens)).select("key").toArrow()
        sent = spark.sparkContext.broadcast((bit_table(candidates), np.sort(spread["key"].to_numpy().view(np.uint64)), ranked, rank_of, word_of))
        pairs = successor_counts(docs, sent, level, tasks, again).withColumn("last", F.col("w") == end)
        if not named:
            pairs = pairs.drop("sfx", "w")
        own = Window.partitionBy("ctx")
        weight = F.greatest(F.col("seen") - F.col("sums"), F.lit(0)) + F.col("kinds")
        law = F.log10((F.col("n") + F.col("weight") * F.pow(F.lit(10.0), "before")) / F.col("total"))
        gain = F.sum(F.col("n") / F.col("seen") * (F.col("own") - F.col("before")) * float(np.log(10)))
        # A run seen so often has a suffix seen as often, so no row is lost here.
        laws = (pairs.join(before, "shorter").drop("shorter").join(candidates.withColumnRenamed("key", "ctx"), "ctx")
                .select("*", F.sum("n").over(own).alias("sums"), F.count(F.lit(1)).over(own).alias("kinds"),
                        (F.col("key") == F.min("key").over(own)).alias("head"))
                .withColumn("weight", weight.cast("double"))
                .withColumn("total", F.col("sums") + F.col("weight"))
                .drop("sums", "kinds")
                .withColumn("own", law)
                .withColumn("kept", gain.over(own) >= least_divergence))
        # The two logarithms are not written, but taken again from what a context's rows share.
        laws = (freed(laws.drop("own"), f"laws{level}")
                .withColumn("rest", F.log10(F.col("weight") / F.col("total")))
                .withColumn("logp", F.when(F.col("kept"), law).otherwise(F.col("before"))))
        sent.unpersist()
        out.append(laws)
        # Next candidates: context and word, seen often, the word not the end.
        candidates = laws.filter((F.col("n") >= least) & ~F.col("last")).select("key", F.col("n").alias("seen"))
        before = laws.select(F.col("key").alias("shorter"), F.col("logp").alias("before"))
    return out


def values(laws: list[DataFrame]) -> DataFrame:
    """``key, n, v``: what a run of words adds to the log-probability of a text
    in which it stands, in one row as a context (the weight left to the suffix)
    and in one as a context with its successor (which takes that weight back)."""
    parts = []
    for level in laws:
        kept = level.filter("kept")
        parts.append(kept.filter("head").select(F.col("ctx").alias("key"), F.col("seen").alias("n"), F.col("rest").alias("v")))
        parts.append(kept.select("key", "n", (F.col("logp") - F.col("before") - F.col("rest")).alias("v")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def grow(docs: DataFrame, vocab: DataFrame, root: Root, depth: int, least_state: float, least_successor: float,
         least_divergence: float) -> Tree:
    """The tree of a small corpus, collected."""
    words = vocab.withColumn("log", root.column(F.col("c"))).toArrow().sort_by("key")
    number = {k: i for i, k in enumerate(words["key"].to_pylist())}
    size, states = len(number), {}
    parents, rests, keys, logs = [], [], [], []
    shorter: dict[int, int] = {}                       # state of every candidate, or of its longest kept suffix
    for laws in levels(docs, vocab, root, depth, least_state, least_successor, least_divergence, named=True):
        mine: dict[int, int] = {}
        for r in laws.collect():
            up = shorter.get(r["sfx"], -1)
            if not r["kept"]:
                mine[r["ctx"]] = up
                continue
            if r["ctx"] not in states:
                states[r["ctx"]] = len(parents)
                parents.append(up)
                rests.append(r["rest"])
            mine[r["ctx"]] = states[r["ctx"]]
            keys.append(states[r["ctx"]] * size + number[r["w"]])
            logs.append(r["logp"])
        shorter = mine
    pairs, logp = joined([np.array(keys, np.int64)], [np.array(logs)])
    return Tree(words["log"].to_numpy(), np.array(parents, np.int64), np.array(rests), pairs, logp)


def joined(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0)
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k)
    return k[order], v[order]


def lookup(tree: Tree, parent: np.ndarray, rest: np.ndarray, pairs: np.ndarray, logp: np.ndarray,
           state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 p(word | state) with the states built so far; state -1 is the root."""
    at_state, out = state.copy(), np.zeros(len(state))
    live = np.arange(len(state))
    size = len(tree.root)
    while len(live):
        below = at_state[live] < 0
        out[live[below]] += tree.root[word[live[below]]]
        live = live[~below]
        if not len(live):
            break
        key = at_state[live] * size + word[live]
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        hit = pairs[at] == key if len(pairs) else np.zeros(len(live), bool)
        out[live[hit]] += logp[at[hit]]
        live = live[~hit]
        out[live] += rest[at_state[live]]
        at_state[live] = parent[at_state[live]]
    return out


VALUES, COUNTS, RUNS_ASKED, WORDS_ASKED, TEXTS = range(5)     # kinds of rows in a lookup
TEXT_COLUMNS = "kind int, block long, doc int, _id {}, trained boolean, n_tokens long, known long, base double, score double"
ASKED, ANSWERED = "part int, keys binary, sizes binary, docs binary", "docs binary, knowns binary, bases binary, scores binary"


def rows_of(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """Rows of the schema; a column that is not given is null."""
    given = (columns.get(f.name, pa.nulls(size, f.type)) for f in schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(given, schema)], schema=schema)


def schema_of(id_kind: pa.DataType, rest: str) -> pa.Schema:
    plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "{}": id_kind}
    return pa.schema([(name, plain[kind]) for name, kind in (c.split(" ") for c in f"{TEXT_COLUMNS}, {rest}".split(", "))])


def table_parts(found: DataFrame, kind: int, parts: int) -> DataFrame:
    """``part, kind, keys, docs`` from ``key, x``: keys and numbers, packed."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows():
            keys, x = map(np.concatenate, zip(*held))
            order = np.argsort(keys)
            keys, x = keys[order], x[order]
            out = [(part, kind, packed(keys[own], True), packed(x[own])) for part, own in split(keys, parts)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "kind", "keys", "docs"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) > BLOCK_KEYS // 4:
                yield rows()
                held = []
        if held:
            yield rows()

    return found.select("key", F.col("x").cast("double").alias("x")).mapInArrow(run, "part int, kind int, keys binary, docs binary")


def looked_up(asked: DataFrame, root: Root, denominator: int, tasks: int) -> DataFrame:
    """Rows of texts as they came, and sums by block: every part of the table
    meets the blocks that asked for its keys."""
    id_kind = asked.schema["_id"].dataType.simpleString()

    def run(batches):
        part, held, texts = None, {VALUES: [], COUNTS: []}, 0
        sums: dict[int, tuple[np.ndarray, ...]] = {}
        ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def ready_table(kind):
            if kind not in ready:
                keys, x = map(np.concatenate, zip(*held[kind])) if held[kind] else (np.empty(0, np.uint64), np.empty(0))
                one, index = np.unique(keys, return_inverse=True)
                ready[kind] = one, np.bincount(index, x, len(one))
            return ready[kind]

        def rows(schema):
            out = []
            for block, (known, base, score) in sums.items():
                at = np.flatnonzero((base != 0) | (score != 0))
                out.append((RUNS_ASKED, block, packed(at.astype(np.uint32), True), *map(packed, (known[at].astype(np.uint32), base[at], score[at]))))
            return rows_of(schema, len(out), **dict(zip(("kind", "block", "docs", "knowns", "bases", "scores"), zip(*out))))

        schema = None
        for batch in batches:
            schema = schema or schema_of(batch.schema.field("_id").type, ANSWERED)
            kinds = batch.column("kind").to_numpy()
            plain = batch.filter(pa.array(kinds == TEXTS))
            if plain.num_rows:
                yield rows_of(schema, plain.num_rows, **{c: plain.column(c) for c in schema.names if c in plain.schema.names and c != "docs"})
            for r in batch.filter(pa.array(kinds != TEXTS)).select(["part", "kind", "block", "doc", "keys", "sizes", "docs"]).to_pylist():
                if r["part"] != part:
                    part, held, ready = r["part"], {VALUES: [], COUNTS: []}, {}
                keys = numbers(r["keys"], np.uint64, True)
                if r["kind"] in held:
                    held[r["kind"]].append((keys, numbers(r["docs"], np.float64)))
                    continue
                if r["block"] not in sums:
                    if texts > HELD_TEXTS:
                        yield rows(schema)
                        sums, texts = {}, 0
                    sums[r["block"]] = np.zeros(r["doc"], np.int64), np.zeros(r["doc"]), np.zeros(r["doc"])
                    texts += r["doc"]
                known, base, score = sums[r["block"]]
                table, x = ready_table(VALUES if r["kind"] == RUNS_ASKED else COUNTS)
                at, hit = find(table, keys)
                found = np.zeros(len(keys))
                found[hit] = x[at[hit]]
                sizes, docs = numbers(r["sizes"], np.uint32), numbers(r["docs"], np.uint16)
                if r["kind"] == RUNS_ASKED:
                    score += np.bincount(docs, np.repeat(found, sizes), len(score))
                else:
                    logs = np.where(hit, root.log10(found), np.log10(root.unseen))
                    known += np.bincount(docs, np.repeat(hit, sizes), len(known)).astype(np.int64)
                    base += np.bincount(docs, np.repeat(np.log10((found + 1) / denominator), sizes), len(base))
                    score += np.bincount(docs, np.repeat(logs, sizes), len(score))
        if sums:
            yield rows(schema)

    return (asked.repartition(tasks, "part").sortWithinPartitions("part", "kind")
            .mapInArrow(run, f"{TEXT_COLUMNS.format(id_kind)}, {ANSWERED}"))


def summed(answered: DataFrame, tasks: int) -> DataFrame:
    """``_id, trained, n_tokens, known, base, score``: every text with its block's sums."""
    wanted = ["_id", "trained", "n_tokens", "known", "base", "score"]
    id_kind = answered.schema["_id"].dataType.simpleString()

    def run(batches):
        block, texts, sums = None, [], []

        def rows():
            every = pa.Table.from_batches(texts).combine_chunks().sort_by("doc")
            out = {c: every.column(c).to_numpy().copy() for c in ("known", "base", "score")}
            for r in sums:
                at = numbers(r["docs"], np.uint32, True)
                out["known"][at] += numbers(r["knowns"], np.uint32)
                out["base"][at] += numbers(r["bases"], np.float64)
                out["score"][at] += numbers(r["scores"], np.float64)
            for c, x in out.items():
                every = every.set_column(every.schema.get_field_index(c), c, pa.array(x))
            return every.select(wanted).combine_chunks().to_batches()

        for batch in batches:
            blocks, kinds = (batch.column(c).to_numpy() for c in ("block", "kind"))
            begin = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])])[:len(blocks)])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(blocks)]):
                if blocks[a] != block and texts:
                    yield from rows()
                    texts, sums = [], []
                block, own = blocks[a], batch.slice(a, b - a)
                if kinds[a] == TEXTS:
                    texts.append(own.select(["doc", *wanted]))
                else:
                    sums += own.select(["docs", "knowns", "bases", "scores"]).to_pylist()
        if texts:
            yield from rows()

    return (answered.repartition(tasks, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(run, f"_id {id_kind}, trained boolean, n_tokens long, known long, base double, score double"))


def score_texts(docs: DataFrame, train: str, depth: int = DEPTH, state_count: int = STATE_COUNT,
                successor_count: int = SUCCESSOR_COUNT, least_divergence: float = LEAST_DIVERGENCE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, in_training, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` is a SQL condition over ``docs`` that picks the training rows.
    ``score`` is the tree's log10 probability of the text, ``base_score`` the
    add-one unigram model's, over the same symbols; both include the end.  Null
    and empty texts are the end alone; repeated rows are counted and scored one
    by one; a null condition leaves a row out of training; without training
    rows every token is unseen, with probability one; an empty table gives no
    rows; other columns of ``docs`` are not returned.  ``docs`` is read several
    times and must give the same rows each time."""
    base = with_code(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.expr(train), F.lit(False)).alias("_train"),
                                  whole_text(text_col).alias("_text"))
    lessons = base.filter("_train")
    words = freed(token_counts(lessons), "words")
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    few = {r["c"]: r["k"] for r in words.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
    root = Root.fit(row["n"], row["v"], few)
    denominator = row["n"] + row["v"] + 1
    parts, tasks = tasks_for(root.tokens) * PARTS_A_TASK, tasks_for(root.tokens // ROUNDS)
    laws = levels(lessons, words, root, depth, state_count, successor_count, least_divergence)
    added, states = values(laws), laws[0].filter("kept and head").select(F.col("ctx").alias("key"))
    for level in laws[1:]:
        states = states.unionByName(level.filter("kept and head").select(F.col("ctx").alias("key")))
    hot_from, common_from = max(1.0, HOT_SHARE * root.tokens), max(1.0, COMMON_SHARE * root.tokens)
    hot = added.filter(F.col("n") >= hot_from).groupBy("key").agg(F.sum("v").alias("v")).toArrow()
    hot_keys, hot_values = hot["key"].to_numpy().view(np.uint64), hot["v"].to_numpy()
    order = np.argsort(hot_keys)
    common = words.filter(F.col("c") >= common_from).toArrow()
    word_keys, word_counts = common["key"].to_numpy().view(np.uint64), common["c"].to_numpy()
    by_word = np.argsort(word_keys)
    shared = docs.sparkSession.sparkContext.broadcast((
        hot_keys[order], hot_values[order], bit_table(added), bit_table(states), word_keys[by_word], word_counts[by_word]))

    def run(batches):
        keys, gains, bits, state_bits, common_keys, common_counts = shared.value
        common_base = np.log10((common_counts + 1) / denominator)
        common_root = root.log10(common_counts)
        guide, common_guide = guide_of(keys), guide_of(common_keys)
        block, texts, schema = TaskContext.get().partitionId() << 32, 0, None
        asked: dict[int, list] = {RUNS_ASKED: [], WORDS_ASKED: []}

        def rows():
            out = []
            for kind, held in asked.items():
                wanted, doc = map(np.concatenate, zip(*held))
                held.clear()
                order = order_of(wanted)
                wanted, doc = wanted[order], doc[order]
                begin = changes(wanted)
                size = np.diff(np.append(begin, len(wanted))).astype(np.uint32)
                wanted, upto = wanted[begin], np.append(begin, len(wanted))
                for part, own in split(wanted, parts):
                    out.append((kind, block, texts, part, packed(wanted[own], True), *map(packed, (size[own], doc[upto[own.start]:upto[own.stop]]))))
            if out:
                yield rows_of(schema, len(out), **dict(zip(("kind", "block", "doc", "part", "keys", "sizes", "docs"), zip(*out))))

        for batch in batches:
            schema = schema or schema_of(batch.schema.field(0).type, ASKED)
            for a, b, codes, n in coded(batch.column(2)):
                size = b - a
                if texts + size > BLOCK_TEXTS or sum(len(k) for held in asked.values() for k, _ in held) > 2 * BLOCK_KEYS:
                    yield from rows()
                    block, texts, asked = block + 1, 0, {RUNS_ASKED: [], WORDS_ASKED: []}
                owner = np.repeat(np.arange(size), n)            # text of every token
                at, held = find_by(common_guide, common_keys, codes[1:])
                known = np.bincount(owner[held], minlength=size)
                plain = np.bincount(owner[held], common_base[at[held]], size).astype(float)
                score = np.bincount(owner[held], common_root[at[held]], size).astype(float)
                asked[WORDS_ASKED].append((codes[1:][~held], (texts + owner[~held]).astype(np.uint16)))
                state = np.zeros(len(codes), bool)               # of the runs that end here
                for m, (end, run_keys) in enumerate(runs_in(codes, depth + 1), 1):
                    # A run has a value as a state, or as a state with its successor.
                    use = may_hold(state_bits, run_keys) if m <= depth else np.zeros(len(end), bool)
                    below, state = state, np.zeros(len(codes), bool)
                    state[end] = use
                    if m > 1:
                        after = np.flatnonzero(below[end - 1] & ~use)
                        use[after] = may_hold(bits, run_keys[after])
                    # A run of one word counts for the token behind it.
                    place, run_keys = owner[(end if m == 1 else end - 1)[use]], run_keys[use]
                    at, hit = find_by(guide, keys, run_keys)
                    score += np.bincount(place[hit], gains[at[hit]], size)
                    asked[RUNS_ASKED].append((run_keys[~hit], (texts + place[~hit]).astype(np.uint16)))
                yield rows_of(schema, size, kind=np.full(size, TEXTS, np.int32), block=np.full(size, block), doc=np.arange(texts, texts + size, dtype=np.int32),
                              _id=batch.column(0).slice(a, size), trained=batch.column(1).slice(a, size), n_tokens=n, known=known,
                              base=plain, score=score, part=np.full(size, ((block >> 32) + (block & 0xFFFFFFFF)) % parts, np.int32))
                texts += size
        if texts:
            yield from rows()

    kind = base.schema["_id"].dataType.simpleString()
    others = added.filter(F.col("n") < hot_from).select("key", F.col("v").alias("x"))
    rare = words.filter(F.col("c") < common_from).select("key", F.col("c").alias("x"))
    scored: list[DataFrame] = []
    for number in range(ROUNDS):
        asked = base.filter(F.pmod(F.xxhash64("_id"), F.lit(ROUNDS)) == number).mapInArrow(run, f"{TEXT_COLUMNS.format(kind)}, {ASKED}")
        for found, what in ((others, VALUES), (rare, COUNTS)):
            asked = asked.unionByName(table_parts(found, what, parts), allowMissingColumns=True)
        scored.append(freed(summed(looked_up(asked, root, denominator, tasks), tasks), f"scored{number}"))
    shared.unpersist()
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    return every.select(
        F.col("_id").alias(id_col), F.col("trained").alias("in_training"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(root.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

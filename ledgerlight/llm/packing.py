"""Packing of tokenized documents into fixed windows (op 8).

Documents are tokenized once and cut into full windows plus one remainder.
Remainders are packed by length alone: shallow combinations of lengths that
fill a window are listed, non-negative least squares finds how often to repeat
each so that together they use up the histogram of remainders, the counts are
rounded down, and what is left is packed greedily, again by length.  The plan
has at most a few combinations per length whatever the number of documents, so
it is worked out on the driver from at most ``window`` counts and sent to the
executors; every remainder finds its place from its length and its rank among
equal lengths.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ledgerlight.llm.common import cut, whole_text, with_code

# The fast coder's pattern fails on blank runs of some hundred thousand
# characters; texts with a run of so many go to the tokenizer itself, as do
# texts that may hold a special token.
BLANK_RUN, SPECIAL = re.compile(r"\s{4096}"), "<|"


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(tokenizer)), fast


class WordTokens:
    """Token ids of texts as little-endian uint32 bytes; a text is coded in one
    call (tables of words already coded cost more than the coder itself)."""

    def __init__(self, tokenizer: str, ranks: str):
        self.whole, self.fast = _encoders(tokenizer, ranks)

    def slow(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        slow = SPECIAL in text or (len(text) > 4096 and BLANK_RUN.search(text))
        return np.array(self.slow(text) if slow else self.fast.encode_ordinary(text), "<u4").tobytes()


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int, tokenizer: str, ranks: str, id_col: str, text_col: str) -> DataFrame:
    """Tokenized documents cut into full windows and a remainder."""
    end = np.zeros(1, "<u4").tobytes()

    def run(batches):
        encode = WordTokens(tokenizer, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    part = ids[4 * at:4 * (at + window)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), total))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return with_code(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, PIECES)


def combinations(window: int, step: int = 32) -> list[tuple[int, ...]]:
    """Two lengths that fill the window, and three of which two lie on a grid."""
    pairs = [(window - a, a) for a in range(1, window // 2 + 1)]
    triples = {tuple(sorted((a, b, window - a - b), reverse=True))
               for a in range(step, window, step) for b in range(a, window - a, step)}
    return pairs + sorted(triples)


def repeat_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares ``min |A x - h|`` by projected gradient steps
    with momentum; column j of A counts the lengths in combination j."""
    depth = max(map(len, combos))
    index = np.array([c + (0,) * (depth - len(c)) for c in combos])  # row 0 takes the padding
    target = histogram.astype(float).copy()
    target[0] = 0.0
    norm = np.zeros(len(histogram))
    np.add.at(norm, index, 1.0)
    norm[0] = 0.0
    rate = 1.0 / max(1.0, depth * norm.max())
    # Start from the pairs that meet exactly.
    x = np.array([min(target[c[0]], target[c[1]]) / (2 if c[0] == c[1] else 1) if len(c) == 2 else 0.0 for c in combos])
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        used = np.bincount(index.ravel(), np.repeat(y, depth), len(histogram))
        used[0] = 0.0
        grad = (used - target)[index].sum(axis=1)
        nxt = np.maximum(0.0, y - rate * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) pairs that use up the histogram of lengths below the window."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], most: int) -> None:
        need = Counter(combo)
        n = min(most, *(int(left[a]) // m for a, m in need.items()))
        if n > 0:
            for a, m in need.items():
                left[a] -= n * m
            out.append((combo, n))

    combos = combinations(window)
    counts = repeat_counts(combos, left) if left.sum() else np.zeros(len(combos))
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 1:
            break
        take(combos[j], int(counts[j]))
    # Greedily: the longest left, then whatever fits best, as often as it lasts.
    while left.any():
        room, combo, used = window, [], Counter()
        while room > 0:
            fits = np.flatnonzero(left[:room + 1] > 0)
            fits = [a for a in fits[::-1] if left[a] > used[a]][:1] if len(fits) else []
            if not fits:
                break
            combo.append(int(fits[0]))
            used[int(fits[0])] += 1
            room -= int(fits[0])
        take(tuple(combo), int(left.max()))
    return out


def segments(packed: list[tuple[tuple[int, ...], int]], first_sequence: int) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence of rank_from, offset) for every slot of the plan."""
    out, at, seq = [], Counter(), first_sequence
    for combo, n in packed:
        offset = 0
        for length in combo:
            out.append((length, at[length], at[length] + n, seq, offset))
            at[length] += n
            offset += length
        seq += n
    return out


def rank_among(df: DataFrame, key: str, order: list[str], counts: dict[int, int], rows_per_group: int = 5_000) -> DataFrame:
    """Add ``_rank`` from 0 among equal ``key`` (small whole numbers, with their
    counts).  A frequent key is spread over as many groups as it needs, by a
    hash of the order columns; group sizes are summed up first."""
    spread = F.array(*[F.lit(-(-counts.get(k, 0) // rows_per_group) or 1) for k in range(max(counts, default=0) + 1)])
    df = df.withColumn("_g", F.pmod(F.xxhash64(*order), F.get(spread, F.col(key)).cast("long")))
    sizes = df.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(key, "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(key, "_g").orderBy(*order)) - 1)
    return ranked.join(sizes, [key, "_g"]).withColumn("_rank", F.col("_base") + F.col("_r")).drop("_g", "_r", "_base")


def pack(docs: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json",
         ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    ``tokenizer`` and ``ranks`` name one vocabulary in the two forms in which
    it is published.  Null and empty texts are the end id alone; rows with
    equal ids or texts are packed one by one; a null id stays null; an empty
    table gives no rows; other columns of ``docs`` are not read."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, window, tokenizer, ranks, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.get(window, 0)
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n if length < window else 0
    slots = segments([((window,), full)] if full else [], 0) + segments(plan(histogram, window), full)
    where = spark.createDataFrame(slots, T.StructType([
        T.StructField(c, T.LongType()) for c in ("_len", "_from", "_to", "_seq", "offset")]))
    ranked = rank_among(cutup, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], counts)
    hit = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(where), hit).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")

"""Whole-text measures for the quality filters (ops 4 and 9)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import whole_text, with_code

BLANK_CHARS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct", "n_upper", "n_digits", "n_punct", "n_marked", "n_stops"]
UPPER_RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    grams = ids[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[k:n + k]
            grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += hit
    edge[width:width + n] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip(BLANK_CHARS)]
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ends = [w[-1:] for w in words]
    return (
        len(text), len(words), len(text) - sum(map(text.count, BLANK_CHARS)), sum(map(text.count, SYMBOLS)),
        len(full), len(full) - len(set(full)), repeated_words(ids), len(set(words)),
        len(UPPER_RUN.findall(text)), len(DIGITS.findall(text)),
        text.count("!") + text.count("?"), sum(map(ends.count, (b"!", b"%", b"#", b"$", b"&", b"*", b"|"))),
        ends.count(b".") + ends.count(b","))


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (renamed ``k0, k1, ...``) and the counts of every text."""
    names = [f"k{i}" for i in range(len(keep))]
    source = with_code(docs).select(*[F.col(c).alias(n) for c, n in zip(keep, names)], whole_text(text_col).alias("_text"))
    schema = ", ".join([f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
                       + [f"{c} long" for c in COUNTS])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [measure(t) for t in batch.column(len(keep)).to_pylist()]
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + COUNTS)

    return source.mapInArrow(run, schema)


def ratios() -> dict:
    """Scale-free features from the counts, as Spark expressions."""
    def share(part: str, whole: str):
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "log_words": F.log1p("n_words"), "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "shout_share": share("n_punct", "n_words"), "marked_share": share("n_marked", "n_words"),
        "stop_share": share("n_stops", "n_words"),
    }


FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "shout_share", "marked_share", "stop_share"]

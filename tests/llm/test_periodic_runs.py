"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerlight.llm import periodic_runs as pr
from ledgerlight.llm import queries
from ledgerlight.llm.common import table
from samples import DOC_SCHEMA, row

SF001 = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24):
    n, found = len(words), {}
    numbers = np.unique(np.array(words, dtype=object if n and isinstance(words[0], str) else int), return_inverse=True)[1]
    for q in range(1, n // 3 + 1):
        # Stretches of words equal to the word q later, from every start.
        same = np.concatenate([[0], numbers[:n - q] == numbers[q:], [0]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if e + q - s >= max(least, 3 * q):
                found.setdefault((int(s), int(e) + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = [w for i, w in enumerate(words) if i not in gone]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(kept)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def repetitive(rng):
    """Words with planted powers, some of them nested or broken."""
    out = []
    while len(out) < rng.choice([10, 60, 300]):
        unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
        out += (unit * rng.choice([1, 2, 3, 4, 9]))[:rng.choice([len(unit), 25, 70, 200])]
        out += [rng.randrange(60) for _ in range(rng.choice([0, 1, 2, 30]))]
    return out


def test_cover_reaches_every_pair_of_residues():
    for i in range(pr.CYCLE):
        for j in range(pr.CYCLE):
            step = pr.STEPS[i, j]
            assert {(i + step) % pr.CYCLE, (j + step) % pr.CYCLE} <= set(pr.COVER)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_extension_against_plain(seed):
    rng = random.Random(seed)
    words = np.array(repetitive(rng) + [99])
    n = len(words)
    i = np.array([rng.randrange(n) for _ in range(80)])
    j = np.array([rng.randrange(n) for _ in range(80)])
    i, j = i[i != j], j[i != j]

    def common(a, b):
        k = 0
        while max(a, b) + k < n and words[a + k] == words[b + k]:
            k += 1
        return k

    assert pr.Extension(words)(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_against_plain(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(rng.choice([1, 3, 12]))]
    texts += [t for t in texts if rng.random() < 0.5]  # copies: equal words of two texts
    if rng.random() < 0.5:
        texts += [[k * 100 + i for i in range(80)] for k in (1, 1, 2, 1)]
    assert pr.runs_of([np.array(t) for t in texts], 300) == [plain_runs(t) for t in texts]


def test_many_pairs_come_in_parts(monkeypatch):
    texts = [[1] * 700, list(range(9)) * 60, [random.Random(3).randrange(2) for _ in range(900)], []]
    want = [plain_runs(t) for t in texts]
    monkeypatch.setattr(pr, "PAIRS", 50)
    assert pr.runs_of([np.array(t, np.int64) for t in texts], 10) == want


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        pr.runs_of([np.arange(30)], 30, min_words=12)


def test_documents_against_plain(spark, edge):
    rng = random.Random(11)
    rows = [row(i, " ".join(f"w{x}" for x in repetitive(rng)).replace(" ", rng.choice([" ", "\n", " \t "]))) for i in range(150)]
    docs = edge.unionByName(spark.createDataFrame(rows, DOC_SCHEMA)).repartition(4)
    want = sorted((repr((d, plain(d, t))) for d, t in docs.select("doc_id", "text").collect()))
    found = queries.cover_runs(docs).collect()
    assert sorted(repr((r["doc_id"], tuple(r[c] for c in COLUMNS))) for r in found) == want
    assert any(r["n_runs"] > 1 for r in found)


def test_query_against_plain(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_cover_runs"](spark, SF001).collect()}
    assert found == {d: plain(d, t) for d, t in docs}


def test_empty_table(empty):
    assert queries.cover_runs(empty).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(9000)) for _ in range(120_000)] + ["x", "y", "z"] * 40_000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = pr.find_runs(docs).first()
    assert [tuple(r) for r in found["runs"]] == [(120_000, 120_000, 3)] and found["n_words"] == 240_000
    assert found["collapsed"] == " ".join(words[:120_003])

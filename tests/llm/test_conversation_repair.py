"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from ledgerlight.llm import conversation_repair as cr
from ledgerlight.llm import queries
from ledgerlight.llm.common import table

SF001 = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, score double, pos long, kind int"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least ``(cost, letters)`` by plain dynamic programming over whole strings:
    ``rows`` are (role, must go, cut off)."""
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserts(layer):
        for _ in range(3):
            for last, (cost, text) in list(layer.items()):
                for role in ok[last].replace("s", ""):
                    found = (cost + 2, text + "I")
                    if role not in layer or found < layer[role]:
                        layer[role] = found
        return layer

    best = inserts(best)
    for role, gone, cut in rows:
        nxt = {}

        def offer(last, cost, text):
            if last not in nxt or (cost, text) < nxt[last]:
                nxt[last] = (cost, text)

        for last, (cost, text) in best.items():
            offer(last, cost + 3, text + "D")
            if not gone:
                if role[:1] and role[:1] in ok[last]:
                    offer(role[0], cost + cut, text + "K")
                for to in ok[last].replace("s", ""):
                    offer(to, cost + 2 + cut, text + "R")
        best = inserts(nxt)
    return min(best[x] for x in ("", "a") if x in best)


def plain(rows):
    """The contract over ``(conv_id, turn, role, text)`` rows, damage first."""
    convs = {}
    for conv, turn, role, text in rows:
        at = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 1:
            text = ""
        if f == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if f == 4:
            role = "user"
        at += [(turn, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = {}
    for conv, at in convs.items():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for turn, role, text in at:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(at, faults)])
        turns = [t for t, _, _ in at if t is not None]
        lines, rest, last = [], iter(at), ""
        for letter in audit:
            _, role, text = next(rest) if letter != "I" else (0, "", "")
            if letter in "RI":
                role = "assistant" if last == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(at, at[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in [*cr.COUNTS, "audit", "repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 4, 7, 30])):
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "é"]),
                         rng.choice(["Yes.", "No?", "so", " ", "", None, "Yes. \n", "long " * 20 + "!", "ü."]), 0.5, 3, 9))
    return rows + [(None, 1, "user", "Who?", 0.1, 1, 1), (None, None, "assistant", "I.", 0.1, 1, 1)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="suaxSUAX.", max_size=9))
def test_auction_finds_the_least_cheapest_edits(symbols):
    rows = [("suax"["suax".find(c.lower())] if c != "." else "user", c == ".", c.isupper()) for c in symbols]
    assert cr.repair_symbols(symbols) == cheapest(rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="suaxSUAX.", min_size=1, max_size=14), st.integers(1, 5))
def test_chunks_chain_to_the_whole(symbols, size):
    parts = [symbols[i:i + size] for i in range(0, len(symbols), size)]
    tables = [cr.chunk_table(p) for p in parts]
    ranks = [[sorted(set(t)).index(x) for x in t] for _, t in tables]
    cost, states, more = cr.chain([(c, r) for (c, _), r in zip(tables, ranks)])
    edits = "".join(t[4 * a + b] for (_, t), (a, b) in zip(tables, states)) + "I" * more
    assert (cost, edits) == cr.repair_symbols(symbols)


def test_prices_are_a_dual_solution():
    for symbols in map("".join, itertools.product("sUa.", repeat=4)):
        price = cr.auction(symbols, cr.GOAL)
        for i, state in itertools.product(range(4), range(4)):
            bounds = [cost + price[i + read][then] for _, cost, read, then in cr.ARCS[symbols[i], state]]
            assert price[i][state] == min(bounds)


@pytest.mark.parametrize("most_rows,bits", [(4096, 12), (0, 12), (3, 1), (0, 2)])
def test_repair_against_plain(spark, monkeypatch, most_rows, bits):
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    rows = made(120, seed=3)
    convs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = cr.damage(convs)
    want = plain([r[:4] for r in rows])
    assert report(cr.repair(damaged, present=damaged["live"], most_rows=most_rows)) == want
    texts = {}
    for r in cr.repair(damaged, present=damaged["live"], texts=True, most_rows=most_rows).collect():
        texts.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for conv, lines in texts.items():
        assert [k for k, _ in sorted(lines)] == list(range(len(lines)))
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(texts.get(conv, []))).encode()).hexdigest() == found[-1]


def test_one_conversation_over_many_tasks(spark):
    """One conversation holds most rows, many of them copies of one row."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Line {rng.randrange(700)}.", 0.0, 0, 0) for t in range(5000)]
    rows += [(7, 3, "user", "Copy.", 0.0, 0, 0)] * 500 + made(30, 9)[:200]
    rows = [r for r in rows if r[0] is not None]
    convs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged = cr.damage(convs)
    assert report(cr.repair(damaged, present=damaged["live"])) == plain([r[:4] for r in rows])


def test_query_against_plain(spark):
    rows = [tuple(r) for r in table(spark, SF001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert report(queries.QUERIES["op13_auction_repair"](spark, SF001)) == plain(rows)


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair(none).count() == 0 and cr.repair(none, texts=True).count() == 0
    damaged = spark.createDataFrame([(1, 1, "user", "Hi."), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    found = report(cr.repair(damaged, present=damaged["conv_id"] == 2))
    empty = hashlib.sha256(b"").hexdigest()
    assert found == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 1, 0, 0, 0, 3, "D", empty)}

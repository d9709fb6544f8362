"""Conversation structure repair (op 13) by the auction shortest-path algorithm.

A conversation is repaired by the cheapest edits that leave the roles
``(system? (user assistant)+)?``.  Edits are arcs of a lattice whose nodes are
(rows read, role written last); costs are integers.  Every node has a price, a
lower bound of its distance to the goal.  A path grows from a node by its
cheapest arc while that arc is tight (extension); where it is not, the node's
price rises to the cheapest arc and the path loses its last node (contraction).
Nodes are taken as origins from the last row back, and a path ends at any node
that an earlier path has settled, so the work is in proportion to the rows.  The
prices are then exact, every arc that is tight under them lies on a cheapest
repair, and following the least letter of the tight arcs gives the least of all
cheapest repairs.

Rows are range-partitioned and sorted by conversation and turn.  A task settles
the conversations that lie wholly inside its range.  Those at the edges of
ranges, and those above ``most_rows`` rows or ``MOST_CHARS`` characters, may go
on in other tasks: their rows are cut into chunks, every chunk is solved for each
pair of first and last state (by the same auction), and only those small tables
meet in one task.  A conversation may so hold any share of all rows.  Two things
stay sequential, in a stream that holds a row at a time: the digest of one
conversation's text, and its edit string, which are one value by definition.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlight.llm.common import cut, with_code

# States: nothing written, then the role written last.
START, SYSTEM, USER, ASSISTANT = range(4)
# What a written user or assistant row leads to; USER follows all but USER.
TURN_TO = (USER, USER, ASSISTANT, USER)
KEEP_FROM = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE_NAME = {USER: "user", ASSISTANT: "assistant"}
DELETE, RENAME, INSERT, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 60
# Prices behind the last row: what is left to insert.
GOAL = (0, 2 * INSERT, INSERT, 0)
GONE = "."
BLANK = " \t\n\x0b\x0c\r"
# Rows of a chunk (a power of two); a conversation beyond these limits is taken in chunks.
CHUNK_BITS, MOST_ROWS, MOST_CHARS = 12, 4096, 1 << 24
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---- the lattice of one chunk ---------------------------------------------

def arcs(symbol: str, state: int) -> list[tuple[str, int, int, int]]:
    """``(letter, cost, rows read, next state)`` out of a node.  A symbol is the
    role's initial (``x``: none of s, u, a), upper case if the text is cut off,
    or GONE if the row has to go."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, TURN_TO[state])]
    if symbol != GONE:
        more, role = (CUT_OFF, symbol.lower()) if symbol.isupper() else (0, symbol)
        out.append(("R", RENAME + more, 1, TURN_TO[state]))
        kept = KEEP_FROM.get(role, {}).get(state)
        if kept is not None:
            out.append(("K", more, 1, kept))
    return sorted(out)


ARCS = {(symbol, state): arcs(symbol, state) for symbol in "suaxSUAX." for state in range(4)}


def unreachable(symbols: str, goal: tuple[int, ...]) -> set[tuple[int, int]]:
    """Nodes from which no path leads to a goal: a written user or assistant row
    is never unwritten, and a system row needs one to keep."""
    if goal[USER] < NEVER or goal[ASSISTANT] < NEVER:
        return set()
    dead, open_start = set(), goal[START] < NEVER
    for i in reversed(range(len(symbols))):
        open_start = open_start or (goal[SYSTEM] < NEVER and symbols[i].lower() == "s")
        dead |= {(i, USER), (i, ASSISTANT)}
        dead |= ({(i, SYSTEM)} if goal[SYSTEM] >= NEVER else set()) | (set() if open_start else {(i, START)})
    return dead


def auction(symbols: str, goal: tuple[int, ...]) -> list[list[int]]:
    """Exact prices of all nodes; ``goal`` prices the states behind the last row."""
    n = len(symbols)
    price = [[0] * 4 for _ in range(n)] + [list(goal)]
    settled = [[False] * 4 for _ in range(n)] + [[True] * 4]
    for i, state in unreachable(symbols, goal):
        price[i][state], settled[i][state] = NEVER, True
    for origin in ((i, state) for i in reversed(range(n)) for state in range(4)):
        path = [origin]
        while not settled[path[-1][0]][path[-1][1]]:
            i, state = path[-1]
            best, to = min((cost + price[i + read][then], (i + read, then))
                           for _, cost, read, then in ARCS[symbols[i], state])
            if price[i][state] < best:
                price[i][state] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for i, state in path:
            settled[i][state] = True
    return price


def trace(symbols: str, price: list[list[int]], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from the first row, and the last state."""
    out, i = [], 0
    while i < len(symbols):
        for letter, cost, read, then in ARCS[symbols[i], state]:
            if price[i][state] == cost + price[i + read][then]:
                out.append(letter)
                i, state = i + read, then
                break
    return "".join(out), state


@lru_cache(maxsize=100_000)
def repair_symbols(symbols: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    price = auction(symbols, GOAL)
    edits, state = trace(symbols, price, START)
    return price[0][START], edits + "I" * (GOAL[state] // INSERT)


def chunk_table(symbols: str) -> tuple[list[int], list[str]]:
    """For every first and last state (4 x 4, by first state): the cost of the
    cheapest edits of a chunk, and the least such edits.  Inserts behind the
    last row belong to the next chunk, so no string is the start of another."""
    costs, texts = [NEVER] * 16, [""] * 16
    for last in range(4):
        price = auction(symbols, tuple(0 if s == last else NEVER for s in range(4)))
        for first in range(4):
            if price[0][first] < NEVER:
                costs[4 * first + last] = price[0][first]
                texts[4 * first + last] = trace(symbols, price, first)[0]
    return costs, texts


def chain(tables: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Cost, chosen (first, last) state of each chunk, and inserts at the end,
    from the chunks' costs and the order of their strings."""
    prices = [list(GOAL)]
    for costs, _ in reversed(tables):
        prices.append([min(costs[4 * a + b] + prices[-1][b] for b in range(4)) for a in range(4)])
    prices.reverse()
    state, out = START, []
    for (costs, order), here, there in zip(tables, prices, prices[1:]):
        tight = [b for b in range(4) if costs[4 * state + b] + there[b] == here[state]]
        last = min(tight, key=lambda b: order[4 * state + b])
        out.append((state, last))
        state = last
    return prices[0][START], out, GOAL[state] // INSERT


def written(edits: str, state: int, rows) -> tuple[list[tuple[str, str, str]], int]:
    """``(edit, role, text)`` of the rows that ``edits`` leave of ``rows``."""
    out, rows = [], iter(rows)
    for letter in edits:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "K":
            state = KEEP_FROM[role[:1]][state]
        elif letter != "D":
            state = TURN_TO[state]
            role = ROLE_NAME[state]
        if letter != "D":
            out.append((letter, role, text))
    return out, state


class Digest:
    """SHA-256 of ``role:text`` lines joined by newlines, fed line by line."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, kept) -> None:
        for _, role, text in kept:
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1


# ---- rows in their order ---------------------------------------------------

def prepared(convs: DataFrame, present: Column | None) -> DataFrame:
    """The columns that count, with nulls read as one space, sorted by range."""
    one = F.lit(" ")
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", one).alias("role"),
                        F.coalesce("text", one).alias("text"), (F.lit(True) if present is None else present).alias("live"))
    # Rows that are not there keep their conversation listed, without their text.
    rows = rows.withColumn("text", F.when(F.col("live"), F.col("text")).otherwise(""))
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    state = (F.when(F.length(bare) == 0, "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k"))
    ini = F.left("role", F.lit(1))
    rows = rows.withColumns({"state": state, "ini": F.when(ini.isin("s", "u", "a"), ini).otherwise("x"),
                             "_salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "text", "_salt"]  # the salt parts copies of one row
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")


SETTLED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINE = "position long, edit string, new_role string, new_text string"
OPEN = "pos long, turn long, role string, text string, state string, ini string, live boolean"


def settle(rows: list[tuple], texts: bool):
    """One whole conversation of ``(turn, role, text, state, ini)``: its report
    and, with ``texts``, its repaired rows."""
    seen, symbols, counts = set(), [], dict.fromkeys(COUNTS, 0)
    for turn, role, text, state, ini in rows:
        if state != "b" and (role, text) in seen:
            state = "d"
        seen.add((role, text))
        symbols.append({"b": GONE, "d": GONE, "t": ini.upper()}.get(state, ini))
        counts["blank"] += state == "b"
        counts["duplicate"] += state == "d"
        counts["truncated"] += state == "t"
    counts["illegal"] = sum(a[4] + b[4] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {r[0] for r in rows} - {None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["cost"], audit = repair_symbols("".join(symbols))
    kept, _ = written(audit, START, ((r[1], r[2]) for r in rows))
    digest = Digest()
    digest.add(kept)
    return [*counts.values(), audit, digest.sha.hexdigest()], kept if texts else []


def batches_of(fields: list, rows, size: int = 2000):
    """Record batches of row tuples in the Arrow ``fields``."""
    schema, held = pa.schema(fields), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow_fields(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_schema
    return list(to_arrow_schema(schema))


def first_pass(convs: DataFrame, present: Column | None, texts: bool, most_rows: int) -> DataFrame:
    """``kind`` 0: reports of settled conversations, 1: their rows (``texts``),
    2: rows of conversations that may go on elsewhere."""
    rows = prepared(with_code(convs), present)
    schema = T.StructType([T.StructField("kind", T.IntegerType()), rows.schema["conv_id"],
                           *T._parse_datatype_string(f"{SETTLED}, {LINE}, {OPEN}").fields])
    fields = arrow_fields(schema)
    n_settled, n_line, n_open = (len(x.split(",")) for x in (SETTLED, LINE, OPEN))

    def run(batches):
        base, at = TaskContext.get().partitionId() << 40, 0

        def open_row(conv, row, live):
            nonlocal at
            at += 1
            return (2, conv, *[None] * (n_settled + n_line), base + at, *(row if live else (None,) * 5), live)

        def closed(conv, held):
            report, kept = settle(held, texts)
            yield (0, conv, *report, *[None] * (n_line + n_open))
            for k, line in enumerate(kept):
                yield (1, conv, *[None] * n_settled, k, *line, *[None] * n_open)

        def rows_out():
            # The first conversation may have begun in the range before.
            conv, held, chars, going_on, first = None, [], 0, True, True
            for batch in batches:
                for c, turn, role, text, live, state, ini in zip(*[x.to_pylist() for x in batch.columns]):
                    if first or c != conv:
                        if not first and not going_on:
                            yield from closed(conv, held)
                        going_on = first
                        conv, held, chars, first = c, [], 0, False
                        if going_on:
                            yield open_row(conv, None, False)
                    if live:
                        row = (turn, role, text, state, ini)
                        if going_on:
                            yield open_row(conv, row, True)
                        else:
                            held.append(row)
                            chars += len(text)
                            if len(held) > most_rows or chars > MOST_CHARS:
                                going_on = True
                    if going_on and held:
                        yield from (open_row(conv, r, True) for r in held)
                        held = []
            if not first and not going_on:  # the last may go on in the range behind
                yield open_row(conv, None, False)
                yield from (open_row(conv, r, True) for r in held)

        return batches_of(fields, rows_out())

    return rows.mapInArrow(run, schema)


# ---- conversations over several tasks --------------------------------------

def chunks_of(flagged: DataFrame) -> DataFrame:
    """Every chunk with its cost table, its strings and the order of them."""
    packed = F.sort_array(F.collect_list(F.struct("pos", F.concat("symbol", "ini").alias("two"))))
    chunks = flagged.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(
        F.min("pos").alias("cid"), F.array_join(F.transform(packed, lambda r: r["two"]), "").alias("two"))
    schema = T.StructType([chunks.schema["conv_id"], *T._parse_datatype_string(
        "cid long, costs array<long>, texts array<string>, order array<int>, illegal long, ends string").fields])
    fields = arrow_fields(schema)

    def run(batches):
        def rows_out():
            for batch in batches:
                for conv, _, cid, two in zip(*[x.to_pylist() for x in batch.columns]):
                    symbols, ini = two[::2], two[1::2]
                    costs, texts = chunk_table(symbols)
                    rank = {t: k for k, t in enumerate(sorted(set(texts)))}
                    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
                    yield conv, cid, costs, texts, [rank[t] for t in texts], bad, ini[0] + ini[-1]
        return batches_of(fields, rows_out(), 50)

    return chunks.mapInArrow(run, schema)


def chained(chunks: DataFrame) -> DataFrame:
    """Per conversation: cost, illegal pairs, and the states each chunk takes."""
    parts = F.sort_array(F.collect_list(F.struct("cid", "costs", "order", "illegal", "ends"))).alias("parts")
    whole = chunks.groupBy("conv_id").agg(parts)
    schema = T.StructType([whole.schema["conv_id"], *T._parse_datatype_string(
        "cost long, illegal long, steps array<struct<cid: long, first: int, last: int, more: int>>").fields])
    fields = arrow_fields(schema)

    def run(batches):
        def rows_out():
            for batch in batches:
                for conv, parts in zip(*[x.to_pylist() for x in batch.columns]):
                    cost, states, more = chain([(p["costs"], p["order"]) for p in parts])
                    illegal = sum(p["illegal"] for p in parts) + sum(
                        a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
                    steps = [{"cid": p["cid"], "first": a, "last": b, "more": 0} for p, (a, b) in zip(parts, states)]
                    steps[-1]["more"] = more
                    yield conv, cost, illegal, steps
        return batches_of(fields, rows_out(), 50)

    return whole.mapInArrow(run, schema)


def streamed(rows: DataFrame, pieces: DataFrame, texts: bool) -> DataFrame:
    """Rows and the edits of their chunks, in order, a row at a time: the edit
    string and digest of each conversation or (``texts``) its repaired rows."""
    both = rows.select("conv_id", "pos", F.lit(1).alias("k"), "role", "text").unionByName(
        pieces.select("conv_id", F.col("cid").alias("pos"), F.lit(0).alias("k"), F.col("first").cast("string").alias("role"),
                      F.col("edits").alias("text")))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k")
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(
        LINE if texts else "audit string, repaired_sha256 string").fields])
    fields = arrow_fields(schema)

    def run(batches):
        def conversations():
            for batch in batches:
                yield from zip(*[x.to_pylist() for x in batch.columns])

        def rows_out():
            conv, audit, digest, todo, state, none = None, [], Digest(), "", START, True
            for c, _, k, role, text in conversations():
                if none or c != conv:
                    if not none and not texts:
                        yield conv, "".join(audit), digest.sha.hexdigest()
                    conv, audit, digest, none = c, [], Digest(), False
                if k == 0:
                    audit.append(text)
                    todo, state, lead = text, int(role), False
                    continue
                # A row's own edit, with the inserts before it (and, for a
                # conversation's last row, those behind it).
                own = len(todo) - len(todo.lstrip("I")) + 1
                rest = todo[own:]
                if rest.strip("I") == "":
                    own, rest = len(todo), ""
                kept, state = written(todo[:own], state, [(role, text)])
                todo = rest
                if texts:
                    for line in kept:
                        yield (conv, digest.lines, *line)
                        digest.lines += 1
                else:
                    digest.add(kept)
            if not none and not texts:
                yield conv, "".join(audit), digest.sha.hexdigest()

        return batches_of(fields, rows_out())

    return with_code(both).mapInArrow(run, schema)


def repair(convs: DataFrame, present: Column | None = None, texts: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; with
    ``texts`` the repaired conversations themselves, ``conv_id, position, edit,
    role, text``, from position 0.

    Rows are taken by turn (nulls first), then role, then text.  Null roles and
    texts are one space (so such a text is blank and such a role never kept); a
    null ``conv_id`` is one conversation.  Rows for which ``present`` is false are
    left out, but their conversation is reported, with zeros, an empty audit and
    the digest of nothing if no other row is left.  Equal rows are duplicates of
    the first.  An empty table gives no rows; other columns are not read."""
    done = cut(first_pass(convs, present, texts, most_rows), "settled")
    open_rows = done.filter("kind = 2")
    live = open_rows.filter("live").select("conv_id", "pos", "turn", "role", "text", "state", "ini")
    # The first of equal rows, by position; a blank row is blank before all.
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = live.groupBy("conv_id", whole.alias("whole")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    flagged = (live.select("conv_id", "pos", "turn", "state", "ini").join(firsts, "pos", "left")
               .withColumn("state", F.when((F.col("state") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("state")))
               .withColumn("symbol", F.when(F.col("state").isin("b", "d"), GONE).when(F.col("state") == "t", F.upper("ini")).otherwise(F.col("ini"))))
    flagged = cut(flagged, "flagged")
    chunks = cut(chunks_of(flagged), "chunks")
    solved = cut(chained(chunks), "solved")
    steps = solved.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.*")
    pieces = steps.join(chunks.select("cid", "texts"), "cid").select(
        "conv_id", "cid", "first",
        F.concat(F.get("texts", F.col("first") * 4 + F.col("last")), F.repeat(F.lit("I"), F.col("more"))).alias("edits"))
    streams = streamed(live, pieces, texts)
    if texts:
        names = [F.col("new_role").alias("role"), F.col("new_text").alias("text")]
        return done.filter("kind = 1").select("conv_id", "position", "edit", *names).unionByName(
            streams.select("conv_id", "position", "edit", *names))
    turns = flagged.groupBy("conv_id", "turn").agg(*[
        F.count_if(F.col("state") == s).alias(name) for s, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    counted = turns.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    parts = open_rows.filter("not live").select("conv_id")
    for more in (counted, solved.drop("steps"), streams):
        parts = parts.unionByName(more, allowMissingColumns=True)
    empty = hashlib.sha256(b"").hexdigest()
    late = parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
                                        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
    return done.filter("kind = 0").select(late.columns).unionByName(late)


def damage(convs: DataFrame) -> DataFrame:
    """``convs`` with faults by the crc32 of ``conv_id:turn``: of twenty rows one is
    marked as not ``live``, one emptied, one without its ``.!?``, one repeated,
    one given to the user; nulls are one space, but for ``conv_id`` and ``turn``."""
    one = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), one))) % 20
    text = F.coalesce("text", one)
    return (convs.select("conv_id", "turn", F.coalesce("role", one).alias("role"), text.alias("text"), fault.alias("_f"))
            .select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    (F.col("_f") != 0).alias("live"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("_f") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))

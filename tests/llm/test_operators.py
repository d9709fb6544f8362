"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import (common, decision_list, empirical_bayes, features, graph, hilbert, mixing, packing, queries, signature_join,
                             suffix_dedup, suffix_tree_lm, toxicity, winnowing)
from ledgerlight.llm.common import table
from samples import DOC_SCHEMA, LABEL_SCHEMA, row

SF001 = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# ---- mixing ---------------------------------------------------------------

def test_mixing_meets_the_repeat_limit(prose):
    rows = mixing.mix_documents(prose, 500, max_repeats=2.0).toPandas()
    texts = texts_of(prose)
    copies = rows.groupby("doc_id").size()
    assert set(copies.index) == set(texts) and copies.max() <= 2
    by = rows.groupby("source").agg(t=("n_tokens", "sum"), w=("weight", "first"))
    assert abs(by.w.sum() - 1) < 1e-9
    # Shares of the stream are the weights, but for the last document of a source.
    assert (by.t / by.t.sum() - by.w).abs().max() < 0.02
    base = rows.drop_duplicates(["doc_id"]).groupby("source").n_tokens.sum()
    assert 1.7 < (by.t / base).max() <= 2.2
    for _, block in rows.groupby("block"):
        assert sorted(block.slot) == list(range(len(block)))


def test_mixing_exponent_against_plain_bisection(spark):
    p = [0.6, 0.3, 0.1]
    shares = spark.createDataFrame([(str(i), int(s * 1000), s) for i, s in enumerate(p)], "source string, tokens long, share double")

    def entropy(a):
        q = [x ** a for x in p]
        return -sum(x / sum(q) * math.log(x / sum(q)) for x in q)

    target = (entropy(0) + entropy(1)) / 2
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= target else (lo, mid)
    assert abs(mixing.solve(shares, 1000, min_entropy=target, cover=False).exponent - lo) < 1e-9
    found = mixing.solve(shares, 1000, max_repeats=2.0)
    # (0.6 / 0.1) ** (1 - a) = 2
    assert abs(found.exponent - (1 - math.log(2) / math.log(6))) < 1e-9


# ---- fingerprints ---------------------------------------------------------

def plain_winnow(grams, w):
    if not grams:
        return set()
    if len(grams) < w:
        return {len(grams) and min(grams)}
    out = set()
    for i in range(len(grams) - w + 1):
        window = grams[i:i + w]
        least = min(window)
        out.add((least, i + max(j for j, g in enumerate(window) if g == least)))
    return out


def test_winnowing_against_plain_windows(spark, prose):
    k, w = 3, 5
    df = prose.select("doc_id", "text")
    fp = winnowing.winnow(df, "text", "fp", k, w)
    grams = winnowing.winnow(df, "text", "fp", k, 1)  # a window of one keeps every gram
    all_grams = {r["doc_id"]: [(x["hash"], x["pos"]) for x in r["fp"]] for r in grams.collect()}
    mask = ~((1 << winnowing.POSITION_BITS) - 1)
    for r in fp.collect():
        full = all_grams[r["doc_id"]]
        if len(full) < w:
            continue
        at = {pos: h for h, pos in full}
        cut = [at[i] & mask for i in range(len(at))]
        want = {p for _, p in plain_winnow(cut, w)}
        assert {x["pos"] for x in r["fp"]} == want
        assert all(at[x["pos"]] == x["hash"] for x in r["fp"])


def test_edited_texts(prose):
    texts = texts_of(prose)
    ids = sorted(texts)
    found = {r["doc_id"]: r for r in winnowing.fingerprint_edits(prose).collect()}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, h = texts[a], len(texts[a]) // 2
        edited = t[:len(t) - h] + texts[b][:h]
        assert found[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[a]["n_chars"] == len(t)
        if texts[a] == texts[b]:
            assert found[a]["near_next"] == 1.0 and found[a]["fingerprint"] == found[b]["fingerprint"]


def test_ranges_keep_the_order(spark):
    rng = random.Random(2)
    ids = sorted({rng.randrange(10) for _ in range(5)} | {rng.randrange(10**15) for _ in range(3000)} | set(range(1000, 1400)))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "_key long, _text string").repartition(5)
    got = {r["_key"]: r["next__text"] for r in winnowing.with_next(df, "_key", ["_text"], rows_per_bucket=50).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


# ---- language model -------------------------------------------------------

def test_unigram_base_and_held_out_gain(spark):
    docs = table(spark, SF001, "documents")
    rows = {r["doc_id"]: r for r in queries.op3_suffix_tree(spark, SF001).collect()}
    tokens = {i: WORDS.findall(t.translate(ASCII)) + [None] for i, t in texts_of(docs).items()}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(t for i in tokens if i not in held for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = rows[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(ts) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[t] > 0 for t in ts)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_next_word_laws_sum_to_one(spark, prose):
    base = prose.select(F.col("text").alias("_text"))
    vocab = suffix_tree_lm.token_counts(base).cache()
    total = vocab.agg(F.sum("c")).first()[0]
    few = Counter(r["c"] for r in vocab.collect())
    root = suffix_tree_lm.Root.fit(total, vocab.count(), few)
    tree = suffix_tree_lm.grow(base, vocab, root, 2, 2e-3, 1e-5, 0.0)
    size = len(tree.root)
    assert len(tree.parent) > 5
    everything = np.arange(size)
    for state in [-1, *range(len(tree.parent))]:
        p = suffix_tree_lm.lookup(tree, tree.parent, tree.rest, tree.pairs, tree.logp, np.full(size, state), everything)
        rest, at = 0.0, state
        while at >= 0:
            rest, at = rest + tree.rest[at], tree.parent[at]
        # held words, and what is left for words that are not held or unseen
        outside = 10.0 ** rest * (1 - (10.0 ** tree.root).sum())
        assert abs((10.0 ** p).sum() + outside - 1) < 1e-6


def test_scores_do_not_depend_on_what_is_joined(prose, monkeypatch):
    def scores():
        rows = suffix_tree_lm.score_texts(prose, "doc_id % 3 <> 1 or doc_id % 2 = 0", state_count=3).collect()
        return {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in rows}

    sent = scores()
    monkeypatch.setattr(suffix_tree_lm, "HOT_SHARE", 1.0)
    monkeypatch.setattr(suffix_tree_lm, "COMMON_SHARE", 1.0)
    for i, row_of in scores().items():
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(row_of, sent[i]))


def test_a_context_stays_known_in_a_larger_corpus(spark):
    rng = random.Random(3)
    few = [row(i, f"f{rng.randrange(400)} rare context here f{rng.randrange(400)}") for i in range(30)]
    few += [row(-1, "f1 rare context here f2"), row(-2, "f1 here context rare f2")]
    filler = [row(100 + i, " ".join(f"f{rng.randrange(400)}" for _ in range(3000))) for i in range(400)]

    def gain(rows):
        docs = spark.createDataFrame(rows, DOC_SCHEMA)
        found = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score_texts(docs, "doc_id >= 0").collect()}
        return found[-1] - found[-2]

    # The same words in and out of their order: by some powers of ten, also
    # where 30 sightings are fewer than 5e-5 of 1.2 million tokens.
    assert gain(few) > 3 and gain(few + filler) > 3


def test_words_are_told_apart_by_their_hashes():
    long = "x" * 300
    texts = ["", " \t\n", "Ab aB abc", "abcdefgh abcdefghi abcdefgh\u00e9", "a", f"{long} {long}y {long}", "\u0130 i\u0307 \u00a0", "A\x0bb\x0cab"]
    texts += [" ".join("w" * n for n in range(1, 40))]
    hashes: dict[bytes, set] = {}
    for part in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array(texts, pa.large_string())):
        codes, n = [], []
        for _, _, c, k in suffix_tree_lm.coded(part):
            codes += c[1:].tolist()
            n += k.tolist()
        words = [t.encode().translate(suffix_tree_lm.LOWER_BYTES).split() for t in texts]
        assert n == [len(w) + 1 for w in words]
        for word, code in zip([w for ws in words for w in [*ws, b""]], codes, strict=True):
            hashes.setdefault(word, set()).add(code)
    assert all(len(c) == 1 for c in hashes.values()) and len({min(c) for c in hashes.values()}) == len(hashes)


def test_no_table_has_a_row_for_every_token(spark, monkeypatch):
    """Also where every value is looked up, what is written is the tree, not the texts' runs."""
    monkeypatch.setattr(suffix_tree_lm, "HOT_SHARE", 1.0)
    monkeypatch.setattr(suffix_tree_lm, "COMMON_SHARE", 1.0)
    rng = random.Random(8)
    docs = spark.createDataFrame([row(i, " ".join(f"w{rng.randrange(25)}" for _ in range(1500))) for i in range(100)], DOC_SCHEMA)
    tables = {}
    write = suffix_tree_lm.cut

    def cut(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_tree_lm, "cut", cut)
    rows = suffix_tree_lm.score_texts(docs, "doc_id >= 0").collect()
    held = 0
    for table_ in tables.values():
        lists = [c for c, kind in table_.dtypes if kind.startswith("array")]
        held += table_.count() + sum(table_.agg(F.sum(F.size(c))).first()[0] for c in lists)
    assert held < sum(r["n_tokens"] for r in rows) / 3


def test_what_is_shuffled_by_the_token_is_small(spark):
    """Frequent words travel as ranks, sorted hashes as steps, and come back as they were."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    mixed = rng.permutation(np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    for some in (keys[:0], keys[:1], keys):
        at, hit = suffix_tree_lm.find_by(suffix_tree_lm.guide_of(some), some, mixed)
        plain, known = suffix_tree_lm.find(some, mixed)
        assert (hit == known).all() and (at[hit] == plain[hit]).all()
        for rising in (False, True):
            blob = suffix_tree_lm.packed(some, rising)
            assert (suffix_tree_lm.numbers(blob, np.uint64, rising) == some).all()
    order = suffix_tree_lm.order_of(mixed)
    assert sorted(order.tolist()) == list(range(len(mixed))) and (np.diff(mixed[order] >> np.uint64(32)) < 2**63).all()

    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.5, 400) % 300) for _ in range(50)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOC_SCHEMA)
    base = docs.select(F.col("text").alias("_text"))
    words = suffix_tree_lm.token_counts(base).cache()
    tokens = words.agg(F.sum("c")).first()[0]
    root = suffix_tree_lm.Root.fit(tokens, words.count(), Counter(r["c"] for r in words.collect()))

    def pairs():
        found = suffix_tree_lm.levels(base, words, root, 3, 5, 2, 0.0, named=True)
        return [{(r["ctx"], r["sfx"], r["w"], r["n"], r["key"], r["last"]) for r in level.collect()} for level in found]

    with pytest.MonkeyPatch.context() as patch:
        ranked = pairs()
        patch.setattr(suffix_tree_lm, "RANKED_SHARE", 1.0)       # no word has a rank
        assert pairs() == ranked
        patch.setattr(suffix_tree_lm, "RANKED_SHARE", 0.01)      # a few have
        assert pairs() == ranked
    assert all(ranked)


def test_texts_are_scored_in_rounds(prose, monkeypatch):
    """One round's lookups are on disk at once; every row, repeated ones too, is in one round."""
    written = []
    write = suffix_tree_lm.cut
    monkeypatch.setattr(suffix_tree_lm, "cut", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    twice = prose.unionByName(prose.filter("doc_id % 7 = 0"))
    rows = suffix_tree_lm.score_texts(twice, "doc_id % 3 <> 1", state_count=3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in twice.collect())
    sizes = [df.count() for name, df in written if name.startswith("scored")]
    assert sum(sizes) == len(rows) and len(sizes) > 1 and max(sizes) < 0.7 * len(rows)


# ---- repeated passages ----------------------------------------------------

def plain_repeats(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        covered = bytearray(len(data))
        for j in range(len(data) - length + 1):
            s = data[j:j + length]
            if s in seen:
                covered[j:j + length] = b"\1" * length
            seen.add(s)
        out[i] = (len(data), bytes(c for c, v in zip(data, covered) if not v),
                  sum(1 for k, v in enumerate(covered) if v and (not k or not covered[k - 1])))
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_repeats_against_plain_scan(prose, length):
    want = plain_repeats(texts_of(prose), length)
    for r in suffix_dedup.remove_repeats(prose, length).collect():
        n, kept, spans = want[r["doc_id"]]
        assert (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) == (n, kept, spans)


def test_repeats_with_small_pieces_and_large_anchors(spark, prose, monkeypatch):
    """Texts longer than a piece, runs cut often, anchors taken window by window."""
    periodic = [row(1000 + i, ("abcab" * 60) + ("x" * i) + ("abcab" * 30)) for i in range(4)]
    docs = prose.unionByName(spark.createDataFrame(periodic, DOC_SCHEMA)).coalesce(1)
    want = plain_repeats(texts_of(docs), 50)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BLOCKS", 3)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(docs, 50).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(97 + c % 3 for c in b)), min_size=1, max_size=6),
       st.integers(3, 9))
def test_induced_windows_are_those_of_a_plain_scan(texts, length):
    """Blocks of the sampling step, all sent through the induction."""
    old = suffix_dedup.ANCHOR
    blocks = suffix_dedup.Blocks(length, min(old, 2))
    rows, content = [], []
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        return
    first, last, at, text, _, h = blocks.windows_of(data, ends)
    if not len(first):
        return
    begin = np.concatenate([[0], ends[:-1]])
    off = first - begin[text]
    for f, l in zip(first, last):
        content.append(data[f:l + length].tobytes())
    r, s, e = suffix_dedup.induce(h[at].view(np.int64), text.astype(np.int64), off, last - first, at - first, content, length)
    got = defaultdict(set)
    for i, a, b in zip(r, s, e):
        got[int(i)] |= set(range(int(a), int(b)))
    seen = set()
    for i, t in enumerate(texts):
        want = set()
        for j in range(len(t) - length + 1):
            if t[j:j + length] in seen:
                want |= set(range(j, j + length))
            seen.add(t[j:j + length])
        assert got[i] == want


def test_whole_characters_are_cut(spark):
    text = "é" * 80 + "ü"
    docs = spark.createDataFrame([row(1, text), row(2, "xy" + text), row(3, "x" + text[1:])], DOC_SCHEMA)
    for r in suffix_dedup.remove_repeats(docs, 21, whole_chars=True).collect():
        bytes(r["kept"]).decode()


# ---- toxicity -------------------------------------------------------------

def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=10), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=12))
def test_automaton_accepts_what_the_distance_says(terms, word):
    trie = toxicity.FuzzyTrie([toxicity.Term(t, False, 1.0) for t in terms])
    near = [(edit_distance(t, word), i) for i, t in enumerate(terms) if edit_distance(t, word) <= toxicity.allowed_edits(len(t))]
    assert trie.match(word) == ((min(near)[1], min(near)[0]) if near else None)


def test_stems_and_misspellings():
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False, 3.0), toxicity.Term("lowe", True, 3.0)])
    assert trie.match("idi0t") == (0, 1) and trie.match("idiott") == (0, 1) and trie.match("lowerung") == (1, 0)
    assert trie.match("ideas") is None and trie.match("") is None


def test_quoted_hits_count_apart():
    scorer = toxicity.Scorer([toxicity.Term("idiot", False, 3.0)])
    direct = dict(zip(toxicity.FEATURES, scorer.features("you are an idiot, all of you")))
    quoted = dict(zip(toxicity.FEATURES, scorer.features('they wrote "what an idiot he is" on the wall')))
    assert direct["direct"] == 3.0 and direct["quoted"] == 0.0
    assert quoted["direct"] == 0.0 and quoted["quoted"] == 3.0


def test_threshold_does_not_move_with_the_number_of_labels(spark):
    def intercept(toxic, rows):
        rng = random.Random(toxic)
        docs, marks = [], []
        for i in range(9 * toxic):
            bad = i < toxic
            text = [f"w{rng.randrange(3000)}" for _ in range(12)]
            if rng.random() < (0.7 if bad else 0.05):
                text[rng.randrange(12)] = "blockhead"
            docs.append(row(i, " ".join(text)))
            marks.append((i, 1, int(bad), 0.0))
        model = toxicity.train(spark.createDataFrame(docs, DOC_SCHEMA), spark.createDataFrame(marks, LABEL_SCHEMA), rows=rows)
        return model.weights[0] + math.log1p(12) * model.weights[-1]

    # All 900 and 7,200 labels, then 1,000 of either class out of 1,000 and 8,000.
    assert abs(intercept(100, 4000) - intercept(1000, 2000)) < 0.7


def test_a_word_with_inflections_is_still_met_with_edits(spark):
    counts = {"idiot": 20, "idiots": 9, "idiotic": 8, "idiocy": 6, "idiott": 4, "idiotx": 3}
    words = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n1 long, n0 long")
    terms = toxicity.learn_lexicon(words, 50, 400)
    assert any(t.stem and t.text == "idio" for t in terms)
    trie = toxicity.FuzzyTrie(terms)
    for word in ("idi0t", "ldiot", "idot"):
        hit = trie.match(word)
        assert hit is not None and hit[1] == 1 and terms[hit[0]].text == "idiot"
    assert trie.match("idioms") == (next(i for i, t in enumerate(terms) if t.stem), 0)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_levenshtein_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


# ---- similar groups -------------------------------------------------------

def plain_groups(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(t.translate(ASCII))
        sets[i] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent,chunk,sets,known", [
    (4, 85, None, 1000, 200_000), (5, 80, 150, 1000, 200_000), (2, 40, 300, 1000, 0), (4, 85, None, 2, 0), (1, 60, None, 3, 5)])
def test_groups_against_all_pairs(prose, monkeypatch, width, percent, chunk, sets, known):
    if chunk:
        monkeypatch.setattr(signature_join, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(signature_join, "CHUNK_SETS", sets)
    monkeypatch.setattr(signature_join, "MAX_FREQUENT", known)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_join.similar_groups(prose, width, percent).collect()}
    assert got == plain_groups(texts_of(prose), width, percent)


@pytest.mark.parametrize("chunk", [20_000_000, 600])
def test_every_link_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(signature_join, "CHUNK_SHINGLES", chunk)
    words = [f"w{i}" for i in range(60)]
    # Each text has one word of its own.
    texts = [" ".join(words[:-4 - i] + [f"own{i}"] + words[-3 - i:]) for i in range(30)] + ["something else altogether here now"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts + texts[:5])], DOC_SCHEMA)
    sets = [set(signature_join.Shingler(4)(t).tolist()) for t in texts]
    want = [sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets]
    assert max(want) > 2 and want[-1] == 0
    found = {r["doc_id"]: r["n_links"] for r in signature_join.similar_groups(docs, 4, 80).collect()}
    assert [found[i] for i in range(len(found))] == want + want[:5]


def test_a_group_of_thousands_is_joined_in_many_tasks(spark, monkeypatch):
    """Every two of 2,500 near copies are linked; no task gets them all."""
    monkeypatch.setattr(signature_join, "CHUNK_SETS", 400)
    words = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{words} own{i}") for i in range(2500)] + [(9000, "a text on its own here")], "doc_id long, text string")
    seen = []
    join_blocks = signature_join.join_blocks
    monkeypatch.setattr(signature_join, "join_blocks", lambda rows, *args: seen.append(
        [r["count"] for r in rows.groupBy("block").count().collect()]) or join_blocks(rows, *args))
    found = signature_join.similar_groups(docs.repartition(7))
    assert {(r["doc_id"] < 9000, r["component_id"], r["n_links"]) for r in found.collect()} == {(True, 0, 2499), (False, 9000, 0)}
    assert max(seen[0]) < 1000 and len(seen[0]) > 20


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([50, 80, 85, 95]))
def test_like_sets_share_a_prefix_shingle_that_occurs_twice(seed, percent):
    """The order by counted rarity, whatever the sample knows."""
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(rng.choice([3, 10, 60]))]
    sets = []
    for _ in range(12):
        own = {g for g in base if rng.random() < 0.97} | {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 3]))}
        sets.append(np.array(sorted(own), np.int64))
    frequent = np.array(sorted(rng.sample(base, len(base) // 4)), np.int64)
    counts = np.array([rng.randrange(3, 9) for _ in frequent], np.int64)
    heads = [signature_join.head(g, percent, frequent, counts) for g in sets]
    df = Counter(g for counted, _ in heads for g in counted.tolist())
    keys = []
    for grams, (counted, extra) in zip(sets, heads):
        size = min(signature_join.prefix_size(len(grams), percent), len(counted))
        first = sorted(counted.tolist(), key=lambda g: (df[g], g))[:size]
        keys.append({g for g in first if df[g] > 1} | set(extra.tolist()))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert keys[i] & keys[j]


def test_rows_without_an_id_of_their_own_are_kept(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(f"{w}{i}" for w in words) for i in range(6)]
    rows = [row(None, texts[0]), row(None, texts[1]), row(None, texts[1]), row(4, texts[2]), row(4, texts[3]),
            row(5, texts[3]), row(6, texts[4]), row(None, texts[4]), row(7, texts[5])]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    kept = sorted((r["text"], r["doc_id"] or 0) for r in signature_join.one_of_each(docs).collect())
    assert kept == list(zip(texts, [0, 0, 4, 4, 6, 7]))
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in signature_join.similar_groups(docs).collect())
    assert found == [(0, 0)] * 3 + [(0, 6), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=40), st.sampled_from([50, 80, 85]))
def test_tree_join_links_what_all_pairs_link(sets, percent):
    arrays = [np.array(sorted(hash((x, 1)) for x in s), np.int64) for s in sets]
    arrays = [np.sort(a) for a in arrays]
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))

    def roots(pairs):
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(sets))]

    want = [(a, b) for a in range(len(sets)) for b in range(a)
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = list(signature_join.tree_join(arrays, order, None, percent))
    assert roots(found) == roots(want) and set(map(frozenset, found)) <= set(map(frozenset, want))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}


def test_components_ask_little_of_the_driver(spark):
    """A round is few jobs without joins, and nodes may span many batches."""
    conf, sc = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext
    was = spark.conf.get(conf)
    hub = [(500, 500 + i) for i in range(1, 40)] + [(540 - i, 500) for i in range(1, 30)]
    edges = [(i, i + 1) for i in range(200)] + hub + hub + [(1000, 539), (-5, 1000), (700, 700)]
    spark.conf.set(conf, "3")
    sc.setJobGroup("test-components", "jobs of components")
    try:
        rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.conf.set(conf, was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    want = dict.fromkeys(range(201), 0) | dict.fromkeys([*range(500, 540), 1000, -5], -5)
    assert len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want
    assert len(sc.statusTracker().getJobIdsForGroup("test-components")) <= 60  # with joins: over 100


def test_cut_has_the_driver_collect_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full():
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    before, common._collected["at"] = full(), -1e9
    common.cut(spark.range(3), "a")
    assert full() > before and common._collected["at"] > 0


# ---- packing --------------------------------------------------------------

def test_packing_round_trip(prose):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(prose, 128).toPandas()
    texts = texts_of(prose)
    for doc_id, part in rows.sort_values("start").groupby("doc_id"):
        ids = whole.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert part.doc_tokens.eq(len(ids)).all() and part.length.sum() == len(ids)
        at = 0
        for p in part.itertuples():
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.values == np.concatenate([[0], seq.length.cumsum().values[:-1]])).all()
        assert seq.length.sum() <= 128
    used = rows.groupby("sequence_id").length.sum()
    assert 1 - used.sum() / (128 * len(used)) < 0.03


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=64, max_size=64))
def test_plan_uses_up_the_histogram(counts):
    histogram = np.array([0, *counts[:63], 0])
    used = Counter()
    for combo, n in packing.plan(histogram, 64):
        assert sum(combo) <= 64 and n > 0
        for a in combo:
            used[a] += n
    assert used == Counter({i: int(c) for i, c in enumerate(histogram) if c})


@settings(max_examples=100, deadline=None)
@given(st.text(" \n\t\0ab'sé1.<|", max_size=40))
def test_cached_tokens_are_the_tokenizers(text):
    encode = packing.WordTokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    want = np.array(encode.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(text) == want


def test_a_text_is_coded_in_one_call():
    """Text after text of words not seen before costs one call each."""
    encode, calls = packing.WordTokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), []

    class Counted:
        def __init__(self, coder):
            self.coder = coder

        def encode_ordinary(self, text):
            calls.append(len(text))
            return self.coder.encode_ordinary(text)

    encode.fast = Counted(encode.fast)
    for n in range(3):
        text = " ".join(f"word{n}x{i}.\n\n a  b" for i in range(500)) + "  "
        want = np.array(encode.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text) == want and len(calls) == n + 1


# ---- quality --------------------------------------------------------------

def test_counts_against_plain_code(prose):
    for t in [*texts_of(prose).values(), "", "a b c d e a b c d e x", "x x x x x x x"]:
        words = WORDS.findall(t)
        grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        marked = {k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        got = dict(zip(features.COUNTS, features.measure(t)))
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(marked))
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_rules_cover_a_known_concept():
    rng = np.random.default_rng(3)
    x = {f: rng.random(3000) for f in features.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["log_words"] <= 0.5))
    rules = decision_list.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= decision_list._covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97


@pytest.mark.parametrize("op,column", [("op4_empirical_bayes", "keep"), ("op9_decision_list", "kept")])
def test_quality_agrees_with_labels(spark, op, column):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[op](spark, sf).select("doc_id", column).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r[column] == bool(r["quality"]) for r in rows) / len(rows) > 0.95


# ---- sharding -------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_hilbert_neighbours_differ_by_one_step(spark, dims, bits):
    side = 1 << bits
    names = [f"x{i}" for i in range(dims)]
    df = spark.range(side ** dims).select("id", *[((F.col("id") / side ** i).cast("long") % side).alias(n) for i, n in enumerate(names)])
    rows = sorted(hilbert.hilbert_index(df, names, bits, "h").collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(side ** dims))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_shards_are_even_and_gapless(prose):
    dims = [hilbert.quantile_cells(prose, F.octet_length("text"), 4), F.pmod(F.xxhash64("source"), F.lit(16))]
    rows = hilbert.hilbert_shards(prose, dims, 7, rows_per_group=10).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert rows.sort_values(["shard", "slot"]).hilbert.is_monotonic_increasing
    texts = texts_of(prose)
    for r in rows.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


@pytest.mark.parametrize("blank", ["\n", "\t", "\u00a0", " "])
def test_tokens_of_long_blank_runs(blank):
    """Runs of a million blanks give the named tokenizer's ids."""
    coder = packing.WordTokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for text in (blank * 1_000_000, f"one{blank * 1_000_000}two three", f"{blank * 5000}x {blank * 4095} y"):
        want = coder.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder(text), "<u4").tolist() == want


def test_pages_of_blanks_do_not_stop_the_packing(spark):
    docs = spark.createDataFrame([(1, "\n" * 2_000_000), (2, "a" + "\n" * 5_000_000 + "b"), (3, "plain words")], "doc_id long, text string")
    rows = packing.pack(docs, 1024).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert len(rows) == 3 and all(r["n"] == r["all"] for r in rows)


def test_copies_do_not_rest_on_ids(spark, prose):
    """Null, equal and distinct ids: every row gets the copies of its source."""
    wanted = Counter(r["source"] for r in mixing.repeat_documents(prose, 1.5).collect())
    assert sum(wanted.values()) > prose.count()
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("doc_id") % 5):
        docs = prose.withColumn("doc_id", ids)
        found = mixing.repeat_documents(docs, 1.5)
        assert found.columns == docs.columns
        counts = Counter(r["source"] for r in found.collect())
        assert all(abs(counts[x] - wanted[x]) <= 3 for x in wanted) and set(counts) == set(wanted)
        assert {r["text"] for r in found.collect()} == {r["text"] for r in docs.collect()}


def test_shards_can_be_skipped(spark):
    """Readers skip shards by the least and greatest size and source: far more
    than with as many shards in order of arrival, and each dimension counts."""
    rows = [(i, "x" * (1 + (i * 7919) % 5003), f"s{(i * 31) % 23:02d}" if i % 3 else "hot") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed = hilbert.with_category_cells(docs, F.col("source"), 4, "_c")
    shards = hilbert.hilbert_shards(placed, [hilbert.quantile_cells(docs, F.octet_length("text"), 4), F.col("_c")], 16)
    found = shards.join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert sorted(found.groupby("shard").size().unique()) == [375]
    spans = found.groupby("shard").agg(lo=("size", "min"), hi=("size", "max"), first=("source", "min"), last=("source", "max"))
    at_size = [((spans.lo <= s) & (spans.hi >= s)).mean() for s in range(100, 5000, 300)]
    at_source = [((spans["first"] <= s) & (spans["last"] >= s)).mean() for s in sorted(set(found.source))]
    assert np.mean(at_size) < 0.45 and np.mean(at_source) < 0.45 and np.mean(at_size) * np.mean(at_source) < 0.15


def test_cells_keep_order_and_share_rows(spark):
    docs = spark.createDataFrame([(i, None if i < 40 else i % 1000, f"c{i % 50:02d}") for i in range(2000)], "i int, v int, c string")
    cells = hilbert.with_category_cells(docs, F.col("c"), 3, "cc").withColumn("vc", hilbert.quantile_cells(docs, F.col("v"), 3)).toPandas()
    for value, cell in (("v", "vc"), ("c", "cc")):
        known = cells.dropna(subset=[value]).sort_values(value)
        assert known[cell].is_monotonic_increasing and set(cells[cell]) == set(range(8))
        assert cells.groupby(cell).size().max() < 2000 / 8 * 1.3
    assert (cells[cells.v.isna()].vc == 0).all()


def test_posteriors_against_plain_formulas(spark, prose):
    """op 4's rates and scores from its own evidence, by plain arithmetic: sparse
    paths lean on their host, hosts on the whole, no row on itself."""
    rng = random.Random(6)
    docs = prose.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("own"), "doc_id")).otherwise(F.col("source")))
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    marks = {i: rng.randrange(2) for i in ids if rng.random() < 0.6}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    rows = empirical_bayes.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    good = {r["doc_id"]: marks.get(r["doc_id"], 1 / (1 + math.exp(-r["evidence"]))) for r in rows}

    def groups(key):
        out = defaultdict(list)
        for r in rows:
            out[key(r)].append(good[r["doc_id"]])
        return out

    hosts, paths = groups(lambda r: r["host"]), groups(lambda r: (r["host"], r["path"]))
    mean = (sum(good.values()) + 1) / (len(rows) + 2)

    def weight(parts):
        n, noise = len(rows), mean * (1 - mean)
        ss = sum(len(p) * (sum(p) / len(p) - mean) ** 2 for p in parts)
        spread = (ss - (len(parts) - 1) * noise) / (n - sum(len(p) ** 2 for p in parts) / n)
        return min(max(noise / spread - 1, 1.0), 1e4) if spread > 0 else 1e4

    k_host, k_path = weight(hosts.values()), weight(paths.values())
    for r in rows:
        own, host, path = good[r["doc_id"]], hosts[r["host"]], paths[r["host"], r["path"]]
        host_rate = (sum(host) - own + k_host * mean) / (len(host) - 1 + k_host)
        path_rate = (sum(path) - own + k_path * host_rate) / (len(path) - 1 + k_path)
        odds = r["evidence"] + math.log(path_rate / (1 - path_rate)) - math.log(mean / (1 - mean))
        assert abs(r["host_rate"] - host_rate) < 1e-9 and abs(r["path_rate"] - path_rate) < 1e-9
        assert abs(r["quality"] - 1 / (1 + math.exp(-odds))) < 1e-9 and r["keep"] == (r["quality"] >= 0.5)
    # A lone row's path says what its host does, and the host what all do.
    lone = next(r for r in rows if len(hosts[r["host"]]) == 1)
    assert abs(lone["path_rate"] - mean) < 1e-9


def test_every_sure_word_is_a_term(spark):
    """The lexicon is as large as the labelled sample makes it."""
    words = spark.createDataFrame([(f"{i:05d}word", 30, 0) for i in range(9000)] + [("plain", 30, 300)], "word string, n1 long, n0 long")
    terms = toxicity.learn_lexicon(words, 100, 900)
    assert {t.text for t in terms if not t.stem} == {f"{i:05d}word" for i in range(9000)}

"""The byte network: gradients, scoring, edges and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import byte_gru as bg
from ledgerlight.llm import queries
from ledgerlight.llm.common import table

SF001 = "/root/testdata/sf0.001"


def small(dtype=np.float32):
    return bg.fresh(["a", "b", "c"], hidden=4, dtype=dtype)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = small(np.float64)
    data = rng.integers(0, 5, (7, 6)).astype(np.uint8)
    mask = np.arange(7)[:, None] < np.array([7, 7, 3, 1, 7, 5])
    label = np.array([0, 1, 2, 0, 1, 2])
    _, grads = bg.loss_and_gradients(net, data, mask, label)
    for a, g in zip(net.arrays(), grads):
        assert a.shape == g.shape
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if a.shape[1] == 256:
                at = (at[0], int(rng.integers(0, 5)))
            kept, step = a[at], 1e-5
            a[at] = kept + step
            up = bg.loss_and_gradients(net, data, mask, label)[0]
            a[at] = kept - step
            down = bg.loss_and_gradients(net, data, mask, label)[0]
            a[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def plain_pooled(net, text):
    """One window after the other, one byte after the other."""
    sums, w = np.zeros(len(net.languages)), bg.WINDOW
    for k in range(0, len(text), w):
        start = max(0, min(k, len(text) - w))
        data = text[start:start + w].ljust(w, b"\0")
        states = []
        for gru, order in ((net.ahead, range(w)), (net.back, reversed(range(w)))):
            h = gru.states_in.shape[1]
            s, at = np.zeros(h), {}
            for t in order:
                a, u = gru.bytes_in[:, data[t]].astype(float), gru.states_in @ s
                z, r = (1 / (1 + np.exp(-(a + u)[i * h:(i + 1) * h])) for i in (0, 1))
                n = np.tanh(a[2 * h:] + r * u[2 * h:])
                s = (1 - z) * n + z * s
                at[t] = s
            states.append(at)
        for t in range(w):
            if k <= start + t < len(text):
                e = np.exp(net.ahead.out @ states[0][t] + net.back.out @ states[1][t] + net.bias[:, 0])
                sums += e / e.sum()
    return sums / max(1, len(text))


def test_scoring_against_a_plain_network(monkeypatch):
    monkeypatch.setattr(bg, "SIDE_BY_SIDE", 5)
    rng = np.random.default_rng(2)
    net = small()
    texts = [bytes(rng.integers(32, 250, n).astype(np.uint8)) for n in (1, 63, 64, 65, 200, 0, 640)]
    found = bg.Scorer(net).pooled(texts)
    assert np.allclose(found, [plain_pooled(net, t) for t in texts], atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    words = {0: [b"der ", b"und ", b"nicht "], 1: [b"the ", b"and ", b"not "], 2: [b"les ", b"est ", b"pas "]}
    labels = rng.integers(0, 3, 400)
    windows = [b"".join(words[c][i] for i in rng.integers(0, 3, 12))[:bg.WINDOW] for c in labels]
    data, mask = bg.windows_to_arrays(windows)
    before = bg.loss_and_gradients(bg.fresh(["de", "en", "fr"]), data, mask, labels)[0]
    net = bg.fit(["de", "en", "fr"], windows, labels, steps=40)
    assert bg.loss_and_gradients(net, data, mask, labels)[0] < 0.3 * before
    again = bg.fit(["de", "en", "fr"], windows, labels, steps=40)
    assert all((a == b).all() for a, b in zip(net.arrays(), again.arrays()))


def test_edge_rows(spark, edge):
    net = bg.fresh(["de", "en"])
    rows = bg.predict(edge, net, ["doc_id", "text"]).collect()
    assert len(rows) == edge.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == letters
    same = {r["text"]: set() for r in rows}
    for r in rows:
        same[r["text"]].add((r["lang_pred"], r["score"]))
    assert all(len(x) == 1 for x in same.values())
    signs = spark.createDataFrame([(1, "12 %$ 3."), (2, "漢字"), (3, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in bg.predict(signs, net).orderBy("doc_id").collect()] == [True, False, False]


def test_no_rows_no_labels_one_language(spark, edge, empty):
    assert bg.train(empty).languages == [] and bg.predict(empty, bg.fresh(["de"])).count() == 0
    unknown = bg.train(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in bg.predict(edge, unknown).collect()} == {("und", 0.0)}
    one = bg.train(edge.withColumn("lang", F.lit("en")))
    assert {(r["lang_pred"], r["score"]) for r in bg.predict(edge, one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(bg, "TRAIN_ROWS", 40)
    seen = {}
    monkeypatch.setattr(bg, "fit", lambda languages, windows, labels: seen.update(n=np.bincount(labels), w=windows) or bg.fresh(languages))
    rows = [(i, f"text {i} " * 40, "hot" if i % 10 else "rare") for i in range(2000)]
    bg.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert seen["n"].tolist() == [20 * bg.WINDOWS_PER_ROW] * 2 and {len(w) for w in seen["w"]} == {bg.WINDOW}


def test_query_on_held_out_documents(spark):
    """Labels of the training remainders alone; the others are predicted."""
    docs = {r["doc_id"]: r for r in table(spark, SF001, "documents").collect()}
    rows = queries.QUERIES["op12_byte_gru"](spark, SF001).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["held_out"] and d["lang"] and any(c.isalpha() for c in d["text"] or ""):
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert right >= 0.97 * total


def test_predictions_come_from_the_text_alone(spark):
    docs = table(spark, SF001, "documents").limit(60)
    net = bg.fresh(["de", "en", "es"])
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert bg.predict(docs, net).collect() == bg.predict(moved, net).collect()


@pytest.mark.parametrize("n", [1, 3])
def test_long_text_is_read_whole(n):
    """What stands at the end of a long text counts as much as its start."""
    net = small()
    scorer = bg.Scorer(net)
    head, tail = b"qqqqzzzz" * 8 * 500, b"eeeeaaaa" * 8 * 500 * n
    both, a, b = scorer.pooled([head + tail, head, tail])
    assert np.allclose(both, (a + n * b) / (n + 1), atol=1e-5)

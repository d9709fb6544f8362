"""Language identification by a bidirectional gated recurrent network (op 12).

The network reads the UTF-8 bytes of a text in windows of 64, once in each
direction, gives every position a distribution over the learned languages, and
a text the mean of its positions' distributions.  It is trained in numpy by
backpropagation through time on windows spread evenly over a bounded sample of
labelled texts (``TRAIN_ROWS`` rows, in equal parts for each language); scoring
covers every byte of every text, many windows side by side in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledgerlight.llm.common import whole_text, with_code

# Labelled rows that the network is fitted on, and windows of each.
TRAIN_ROWS, WINDOWS_PER_ROW = 4096, 8
WINDOW, HIDDEN = 64, 8
# Minibatches, windows of one, and the first learning rate (falls to 0).
STEPS, BATCH, RATE = 240, 512, 0.02
# Windows that a task runs side by side.
SIDE_BY_SIDE = 2048
UNDETERMINED = "und"


@dataclass
class Gru:
    """One direction.  ``bytes_in`` (3H x 256) is what each byte adds to the
    update gate, the reset gate and the candidate; ``states_in`` (3H x H) what
    the last state adds; ``out`` (C x H) leads to the languages' logits."""
    bytes_in: np.ndarray
    states_in: np.ndarray
    out: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.bytes_in, self.states_in, self.out]


@dataclass
class Network:
    languages: list[str]
    ahead: Gru
    back: Gru
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.ahead.arrays(), *self.back.arrays(), self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 5, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)

    def direction():
        return Gru(rng.normal(0, 0.3, (3 * hidden, 256)).astype(dtype),
                   rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(dtype),
                   rng.normal(0, hidden ** -0.5, (len(languages), hidden)).astype(dtype))

    return Network(languages, direction(), direction(), np.zeros((len(languages), 1), dtype))


# ---- training: backpropagation through time --------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def run_ahead(gru: Gru, data: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States (T x H x B) over ``data`` (T x B bytes), and what backward needs."""
    steps, batch = data.shape
    h = gru.states_in.shape[1]
    states = np.zeros((steps + 1, h, batch), gru.bytes_in.dtype)
    gates, memory, candidates = [], [], []
    for t in range(steps):
        a, u = gru.bytes_in[:, data[t]], gru.states_in @ states[t]
        both = sigmoid(a[:2 * h] + u[:2 * h])
        n = np.tanh(a[2 * h:] + both[h:] * u[2 * h:])
        states[t + 1] = n + both[:h] * (states[t] - n)
        gates.append(both)
        memory.append(u[2 * h:])
        candidates.append(n)
    return states[1:], (states, gates, memory, candidates)


def run_back(gru: Gru, data: np.ndarray, kept: tuple, d_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of ``bytes_in`` and ``states_in`` from those of the states."""
    states, gates, memory, candidates = kept
    steps, batch = data.shape
    h = gru.states_in.shape[1]
    into = np.empty((steps, 3 * h, batch), gru.bytes_in.dtype)
    d_states_in = np.zeros_like(gru.states_in)
    flow = np.zeros((h, batch), gru.bytes_in.dtype)
    for t in reversed(range(steps)):
        z, r, n, q, last = gates[t][:h], gates[t][h:], candidates[t], memory[t], states[t]
        flow = flow + d_states[t]
        d_n = flow * (1 - z) * (1 - n * n)
        d_z = flow * (last - n) * z * (1 - z)
        d_r = d_n * q * r * (1 - r)
        into[t] = np.concatenate([d_z, d_r, d_n])
        through = np.concatenate([d_z, d_r, d_n * r])
        d_states_in += through @ last.T
        flow = flow * z + gru.states_in.T @ through
    flat, rows = data.ravel(), into.transpose(1, 0, 2).reshape(3 * h, -1)
    d_bytes = np.stack([np.bincount(flat, weights=row, minlength=256) for row in rows]).astype(gru.bytes_in.dtype)
    return [d_bytes, d_states_in]


def loss_and_gradients(net: Network, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all real positions of ``data`` (T x B), and the
    gradients in the order of ``net.arrays()``."""
    reverse = np.ascontiguousarray(data[::-1])
    f, kept_f = run_ahead(net.ahead, data)
    b, kept_b = run_ahead(net.back, reverse)
    b = b[::-1]
    logits = np.matmul(net.ahead.out, f) + np.matmul(net.back.out, b) + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    count, columns = mask.sum(), np.arange(data.shape[1])
    loss = -(np.log(p[:, label, columns] + 1e-12) * mask).sum() / count
    p[:, label, columns] -= 1
    d = p * (mask[:, None, :] / count).astype(p.dtype)
    d_out_f, d_out_b = (np.einsum("tcb,thb->ch", d, s) for s in (f, b))
    d_f, d_b = np.matmul(net.ahead.out.T, d), np.matmul(net.back.out.T, d)[::-1]
    return float(loss), [*run_back(net.ahead, data, kept_f, d_f), d_out_f,
                         *run_back(net.back, reverse, kept_b, d_b), d_out_b, d.sum(axis=(0, 2))[:, None]]


def windows_to_arrays(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, T x B."""
    data = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    mask = np.arange(WINDOW) < np.array([len(w) for w in windows])[:, None]
    return np.ascontiguousarray(data.T), np.ascontiguousarray(mask.T)


def fit(languages: list[str], windows: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on minibatches of windows, gradients cut to norm 1."""
    net, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return net
    data, mask = windows_to_arrays(windows)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    for step in range(steps):
        at = rng.integers(0, len(windows), BATCH)
        _, grads = loss_and_gradients(net, np.ascontiguousarray(data[:, at]), mask[:, at], labels[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / steps)
        for a, g, m, v in zip(net.arrays(), grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(a.dtype)
    return net


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Network:
    """A network from ``docs`` with a text and a language (and ``usable``): at
    most ``TRAIN_ROWS`` rows, equally many of each language (at least one), those
    of the smallest hash.  Only their bytes and labels are used."""
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0) & (F.lit(True) if usable is None else usable))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("bytes"),
                       F.xxhash64(id_col, text_col).alias("hash"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    each = max(1, TRAIN_ROWS // max(1, len(languages)))
    # A cut by hash first, so that few more rows than are wanted get to the sort.
    slots = 1 << 30
    limits = {lang: slots if n <= 2 * each else int(slots * 1.3 * each / n) for lang, n in counts.items()}
    if not limits:
        return fresh([])
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    rows = rows.filter(F.pmod("hash", F.lit(slots)) < limit[F.col("lang")])
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("hash", F.lit(slots)), "hash", "bytes")))
    room = F.greatest(F.octet_length("bytes") - WINDOW, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_ROW - 1)),
                                          lambda j: F.floor(j * room / (WINDOWS_PER_ROW - 1)).cast("int")))
    found = (rows.filter(F.col("k") <= each).select("lang", "k", F.posexplode(F.transform(
        starts, lambda s: F.substring(F.col("bytes"), s + 1, F.lit(WINDOW)))).alias("j", "window")).collect())
    found = sorted(found, key=lambda r: (r["lang"], r["k"], r["j"]))
    return fit(languages, [bytes(r["window"]) for r in found], np.array([languages.index(r["lang"]) for r in found]))


# ---- scoring ---------------------------------------------------------------

class Scorer:
    """The network's position distributions, for many windows side by side."""

    def __init__(self, net: Network):
        self.net, h = net, net.ahead.states_in.shape[1]
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: one tanh for both gates.
        scale = np.concatenate([np.full(2 * h, 0.5), np.ones(h)])[:, None].astype(np.float32)
        self.ways = [(np.ascontiguousarray(g.bytes_in * scale), g.states_in * scale, g.out, step)
                     for g, step in ((net.ahead, 1), (net.back, -1))]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """T x C x B probabilities of ``data`` (T x B bytes)."""
        steps, batch = data.shape
        logits = np.empty((steps, len(self.net.languages), batch), np.float32)
        for bytes_in, states_in, out, way in self.ways:
            h = states_in.shape[1]
            state = np.zeros((h, batch), np.float32)
            a, u = np.empty((3 * h, batch), np.float32), np.empty((3 * h, batch), np.float32)
            for t in range(steps)[::way]:
                np.take(bytes_in, data[t], axis=1, out=a, mode="clip")
                np.matmul(states_in, state, out=u)
                gates, n = a[:2 * h], a[2 * h:]
                gates += u[:2 * h]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                n += gates[h:] * u[2 * h:]
                np.tanh(n, out=n)
                state -= n
                state *= gates[:h]
                state += n
                if way == 1:
                    np.matmul(out, state, out=logits[t])
                else:
                    logits[t] += out @ state
        logits += self.net.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution of each text's positions (texts x C), zeros for
        empty texts.  The last window of a text reaches back over bytes that
        were seen, which count once."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        buffer = np.frombuffer(b"".join(texts) + b"\0" * WINDOW, np.uint8)
        per = -(-sizes // WINDOW)
        of = np.repeat(np.arange(len(texts)), per)
        k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        sums = np.zeros((len(texts), len(self.net.languages)))
        steps = np.arange(WINDOW)
        for at in range(0, len(of), SIDE_BY_SIDE):
            doc, seen = of[at:at + SIDE_BY_SIDE], k[at:at + SIDE_BY_SIDE] * WINDOW
            start = np.maximum(np.minimum(seen, sizes[doc] - WINDOW), 0)
            place = start[:, None] + steps
            data = buffer[begin[doc][:, None] + place]
            data[place >= sizes[doc][:, None]] = 0
            counts = ((place >= seen[:, None]) & (place < sizes[doc][:, None])).astype(np.float32)
            found = np.einsum("tcb,bt->bc", self.positions(np.ascontiguousarray(data.T)), counts)
            np.add.at(sums, doc, found)
        return sums / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, net: Network, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, the mean
    probability of that language over all bytes of the text.

    A text that is null or has no letter (nor, then, an empty one) is ``und``
    with score 0, as is every text if no language was learned; rows with equal
    ids are judged one by one, equal texts alike; equal probabilities go to the
    language first by name; an empty table gives no rows; no other column is
    read.  With one learned language every other text gets it, with score 1."""
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    rows = with_code(docs).select(*[F.col(c).alias(n) for c, n in zip(keep, names)], whole_text(text_col).alias("text"))
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary"))
    rows = rows.select(*names, lettered.alias("bytes"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    languages = net.languages

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            judged = [i for i, t in enumerate(texts) if t] if languages else []
            if judged:
                pooled = scorer.pooled([texts[i] for i in judged])
                for i, best, p in zip(judged, pooled.argmax(axis=1).tolist(), pooled.max(axis=1).tolist()):
                    langs[i], scores[i] = languages[best], min(1.0, p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")

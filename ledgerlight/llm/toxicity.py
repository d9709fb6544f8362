"""Toxicity scores from a learned lexicon met with Levenshtein automata (op 6).

The lexicon (words and word stems) is learned from labelled rows by log-odds
of document counts.  It is held as a trie; a word is run through the product of
the trie and the automaton that allows a few edits, which is made deterministic
as words come along, so a word costs one table step a letter.  Hits in quoted
or reported speech are told from direct ones by the words around them, and a
logistic model over the sums of both kinds gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm import winnowing
from ledgerlight.llm.common import cut, hash_sample, whole_text, with_code
from ledgerlight.llm.empirical_bayes import fit_logistic

# Bounds of the labelled sample and of a task's word memory.
TRAIN_ROWS, MEMO_WORDS = 20_000, 500_000
STEM_CHARS = range(4, 9)
WINDOW, NEAR = 20, 6
QUOTES = "\"“”„«»"
# Words that introduce somebody else's speech.
REPORTING = frozenset("said says quoted quote called calls wrote dit sagte dijo".split())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = ["direct", "edited", "quoted", "window", "hits", "words"]


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float
    edited_weight: float = 0.0


def allowed_edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


class FuzzyTrie:
    """Lexicon trie times Levenshtein automaton, determinized on demand.

    A state holds pairs (trie node, edits so far) and the stem already met.
    ``match`` gives (term index, edits) of the closest term, or None; a stem
    matches every word that starts with it, without edits."""

    MAX_STATES = 50_000

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.reach: list[int] = [0]  # edits that some term below a node allows
        for number, term in enumerate(terms):
            node, edits = 0, 0 if term.stem else allowed_edits(len(term.text))
            self.reach[0] = max(self.reach[0], edits)
            for letter in term.text:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], edits)
            (self.stem_at if term.stem else self.word_at)[node] = number
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.results: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}, -1)

    def _state(self, pairs: dict[int, int], stem: int) -> int:
        """Number of the state, after closing it under skipped term letters."""
        todo = list(pairs)
        while todo:
            node = todo.pop()
            spent = pairs[node] + 1
            for child in self.children[node].values():
                if spent <= self.reach[child] and spent < pairs.get(child, 99):
                    pairs[child] = spent
                    todo.append(child)
        key = (frozenset(pairs.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append((pairs, stem))
            self.steps.append({})
            best = None
            for node, edits in pairs.items():
                word = self.word_at.get(node)
                if word is not None and edits <= allowed_edits(len(self.terms[word].text)):
                    if best is None or (edits, word) < (best[1], best[0]):
                        best = (word, edits)
            if stem >= 0 and (best is None or best[1] > 0):
                best = (stem, 0)
            self.results.append(best)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        pairs, stem = self.members[state]
        out: dict[int, int] = {}
        for node, edits in pairs.items():
            for c, child in self.children[node].items():
                cost = edits + (c != letter)
                if cost == edits or cost <= self.reach[child]:
                    if cost < out.get(child, 99):
                        out[child] = cost
                if cost == edits == 0 and child in self.stem_at:
                    stem = self.stem_at[child]
            if edits + 1 <= self.reach[node] and edits + 1 < out.get(node, 99):
                out[node] = edits + 1
        nxt = self.steps[state][letter] = self._state(out, stem)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.members) > self.MAX_STATES:
            self._reset()
        state = self.start
        for letter in word:
            nxt = self.steps[state].get(letter)
            state = self._step(state, letter) if nxt is None else nxt
            if not self.members[state][0] and self.members[state][1] < 0:
                return None
        return self.results[state]


class Scorer:
    """Features of a text from a lexicon."""

    def __init__(self, terms: list[Term]):
        self.terms, self.trie = terms, FuzzyTrie(terms)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def features(self, text: str) -> tuple[float, ...]:
        tokens = text.lower().split()
        fresh = set(tokens) - self.seen
        if len(self.seen) + len(fresh) > MEMO_WORDS:
            self.seen, self.hits, fresh = set(), {}, set(tokens)
        for token in fresh:
            found = self.trie.match(EDGES.sub("", token))
            if found is not None:
                self.hits[token] = found
        self.seen |= fresh
        if not self.hits or self.hits.keys().isdisjoint(tokens):
            return (0.0, 0.0, 0.0, 0.0, 0.0, float(np.log1p(len(tokens))))
        direct: dict[int, float] = {}
        edited: dict[int, float] = {}
        quoted: dict[int, float] = {}
        places: list[tuple[int, float]] = []
        spans = quoted_words(text, tokens)
        for i, token in enumerate(tokens):
            hit = self.hits.get(token)
            if hit is None:
                continue
            term, edits = hit
            weight = self.terms[term].edited_weight if edits else self.terms[term].weight
            if (spans is not None and spans[i]) or not REPORTING.isdisjoint(tokens[max(0, i - NEAR):i]):
                quoted[term] = max(weight, quoted.get(term, 0.0))
            else:
                kind = edited if edits else direct
                kind[term] = max(weight, kind.get(term, 0.0))
                places.append((i, weight))
        best, total, first = 0.0, 0.0, 0
        for place, weight in places:
            total += weight
            while place - places[first][0] >= WINDOW:
                total -= places[first][1]
                first += 1
            best = max(best, total)
        return (sum(direct.values()), sum(edited.values()), sum(quoted.values()), best,
                float(np.log1p(len(places))), float(np.log1p(len(tokens))))


def quoted_words(text: str, tokens: list[str]) -> list[bool] | None:
    """Whether each word stands between quotation marks; a line end closes them."""
    if not any(q in text for q in QUOTES):
        return None
    out: list[bool] = []
    for line in text.lower().split("\n"):
        inside = False
        for token in line.split():
            marks = sum(map(token.count, QUOTES))
            out.append(inside or marks > 0)
            inside ^= marks % 2 == 1
    return out if len(out) == len(tokens) else None


def plain_words(text: str) -> set[str]:
    return {EDGES.sub("", t) for t in set(text.lower().split())} - {""}


def word_counts(sample: DataFrame) -> DataFrame:
    """Toxic and clean documents of the sample that hold each word."""
    def run(batches):
        for batch in batches:
            counts: tuple[dict, dict] = ({}, {})
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = counts[toxic]
                for word in plain_words(text):
                    own[word] = own.get(word, 0) + 1
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(words, pa.string()),
                pa.array([counts[1].get(w, 0) for w in words], pa.int64()),
                pa.array([counts[0].get(w, 0) for w in words], pa.int64())], names=["word", "n1", "n0"])

    return (with_code(sample).select("text", "toxic").mapInArrow(run, "word string, n1 long, n0 long")
            .groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def odds(n1, n0, toxic: int, clean: int) -> Column:
    return F.log((n1 + 0.5) / (toxic + 1.0)) - F.log((n0 + 0.5) / (clean + 1.0))


def learn_lexicon(words: DataFrame, toxic: int, clean: int, least: int = 3, sure: float = 2.0) -> list[Term]:
    """Words and stems that mark toxic documents, with their log-odds.

    A term needs ``least`` toxic documents and log-odds that exceed ``sure`` by
    a standard error; all that have them are terms, as many as the labelled
    sample holds.  Words under a chosen stem come last: the stem has their exact
    spellings too, but only words are met with edits."""
    n1, n0 = F.col("n1"), F.col("n0")
    strong = odds(n1, n0, toxic, clean) - F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)) >= sure
    stems = (words.withColumn("term", F.explode(F.array(*[
        F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_CHARS])))
        .filter("term is not null").groupBy("term")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum((F.col("n1") > 0).cast("int")).alias("kinds"))
        .filter("kinds >= 5").withColumn("stem", F.lit(True)))
    found = (words.select(F.col("word").alias("term"), "n1", "n0").withColumn("stem", F.lit(False))
             .unionByName(stems.drop("kinds")).filter((n1 >= least) & strong)
             .withColumn("weight", odds(n1, n0, toxic, clean))
             .orderBy(F.desc("n1"), F.length("term"), "term", "stem").collect())
    roots: set[str] = set()
    begun: set[str] = set()  # what the chosen whole words begin with
    out: list[Term] = []
    covered: list[Term] = []
    for r in found:
        heads = {r["term"][:k] for k in STEM_CHARS if k < len(r["term"]) or (r["stem"] and k == len(r["term"]))}
        if heads & roots:
            if not r["stem"]:
                covered.append(Term(r["term"], False, float(r["weight"])))
            continue
        if r["stem"]:
            # A stem that one whole word accounts for adds nothing to the word.
            if r["term"] in begun:
                continue
            roots.add(r["term"])
        else:
            begun |= {r["term"][:k] for k in STEM_CHARS if k <= len(r["term"])}
        out.append(Term(r["term"], r["stem"], float(r["weight"])))
    return out + covered


def weigh_edits(terms: list[Term], words: DataFrame, toxic: int, clean: int) -> list[Term]:
    """Weights of misspelled hits: the log-odds of the words that each term's
    automaton accepts with edits, drawn towards half the term's own weight."""
    def run(batches):
        trie = FuzzyTrie(terms)
        for batch in batches:
            rows = [(hit[0], a, b) for w, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))
                    if (hit := trie.match(w)) is not None and hit[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))],
                                             names=["term", "n1", "n0"])

    counts = {r["term"]: (r["n1"], r["n0"]) for r in words.mapInArrow(run, "term long, n1 long, n0 long")
              .groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()}
    out = []
    for i, t in enumerate(terms):
        n1, n0 = counts.get(i, (0, 0))
        prior = float(np.exp(t.weight / 2)) * toxic / max(clean, 1)
        ratio = np.log((n1 + prior) / (toxic + 1)) - np.log((n0 + 1.0) / (clean + 1))
        out.append(Term(t.text, t.stem, t.weight, float(np.clip(ratio, 0.0, t.weight))))
    return out


def scored(docs: DataFrame, terms: list[Term], keep: list[str], text_col: str) -> DataFrame:
    """The ``keep`` columns and the features of every text."""
    schema = ", ".join([f"{n} {t}" for n, t in docs.select(*keep).dtypes] + [f"{f} double" for f in FEATURES])

    def run(batches):
        scorer = Scorer(terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [scorer.features(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(c, pa.float64()) for c in zip(*rows)],
                names=keep + FEATURES)

    return with_code(docs).select(*keep, whole_text(text_col).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    weights: list[float]

    def score(self) -> Column:
        out = F.lit(self.weights[0])
        for f, w in zip(FEATURES, self.weights[1:]):
            out = out + F.col(f) * w
        return 1 / (1 + F.exp(-F.least(F.greatest(out, F.lit(-30.0)), F.lit(30.0))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label: str = "toxic", usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled rows (half of them
    toxic at most), those with the smallest id hashes.  ``usable`` tells which
    rows of ``labels`` may be learned from.  Near copies count once.  The
    intercept is set for the classes' counts over all usable labels, as the
    sample holds another share of either."""
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("toxic")).dropna()
    if usable is not None:
        marks = labels.filter(usable).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("toxic")).dropna()
    marks = marks.filter("toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    every = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for value in (1, 0):
        few = hash_sample(marks.filter(F.col("toxic") == value), "_id", rows // 2)
        picked += few.orderBy(F.xxhash64("_id"), "_id").limit(rows // 2).collect()
    sample = spark.createDataFrame(picked, "_id long, toxic int")
    # One row for texts that agree in the smallest hash of their word 4-grams.
    picked_docs = (docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
                   .join(F.broadcast(sample), "_id"))
    texts = cut(winnowing.winnow(picked_docs, F.lower("text"), "_fp", k=4, w=1)
                .withColumn("_least", F.array_min(winnowing.hashes("_fp")))
                .dropDuplicates(["_least", "toxic"]).select("text", "toxic"), "tox_sample")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + 1) / (toxic + clean + 2) if toxic + clean else 0.25
        return Model([], [float(np.log(rate / (1 - rate)))] + [0.0] * len(FEATURES))
    counts = cut(word_counts(texts), "tox_words")
    terms = weigh_edits(learn_lexicon(counts, toxic, clean), counts, toxic, clean)
    found = scored(texts, terms, ["toxic"], "text").collect()
    x = np.array([[r[f] for f in FEATURES] for r in found])
    y = np.array([r["toxic"] for r in found], float)
    weights = [float(w) for w in fit_logistic(x, y)]
    weights[0] += float(np.log(every[1] / every[0]) - np.log(toxic / clean))
    return Model(terms, weights)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, the features, ``score`` (0 to 1) and ``predicted``.

    Null text is empty, and an empty text has the score of one without hits;
    very long texts are scored whole; repeated rows are scored one by one; an
    empty table gives no rows."""
    out = scored(docs, model.terms, keep, text_col).withColumn("score", model.score())
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = scored(docs.toDF(*names), model.terms, names, names[docs.columns.index(text_col)])
    return wide.filter(model.score() < 0.5).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

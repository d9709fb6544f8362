"""Quality rules as a learned decision list (op 9).

Sequential covering: a rule is grown as a conjunction of thresholds, each
chosen for the largest information gain on two thirds of the labelled rows,
pruned on the other third, and kept if it is precise on both; the rows it covers
are taken out and the next rule is grown.  The list becomes one ordered
conditional expression that Spark evaluates on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import cut, hash_sample
from ledgerlight.llm.features import FEATURES, measured, ratios

# Labelled rows the rules are learned from, at most, chosen by a hash of the id.
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for test in rule:
        hit &= test.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the threshold with the best gain until no good row is covered."""
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < most and live.any() and not bad[live].all():
        p, n = bad[live].sum(), live.sum()
        if p == 0:
            return ()
        best: tuple[float, Test | None] = (1e-9, None)
        for name in FEATURES:
            values = x[name][live]
            grid = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 1)[1:-1]))
            order = np.argsort(values, kind="stable")
            below = np.searchsorted(values[order], grid, side="right")
            bad_below = np.concatenate([[0], np.cumsum(bad[live][order])])[below]
            for above, covered, hits in ((False, below, bad_below), (True, n - below, p - bad_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(hits > 0, hits * (np.log2(hits / covered) - np.log2(p / n)), -1.0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), Test(name, above, float(grid[int(gain.argmax())])))
        if best[1] is None:
            break
        rule += (best[1],)
        live &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop trailing thresholds while (p - n) / (p + n) on the pruning rows does not fall."""
    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        return (2 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 24, most_tests: int = 5,
          precision: float = 0.9, least_rows: int = 5, cuts: int = 64) -> list[Rule]:
    """Rules that find bad rows, in order.  No bad rows, no rules."""
    fold = np.arange(len(bad)) % 3 == 2
    grow, prune = ~fold, fold.copy()
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[grow].sum() >= least_rows:
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], most_tests, cuts)
        if not rule:
            break
        rule = _prune(rule, {f: v[prune] for f, v in x.items()}, bad[prune])
        hit = _covers(rule, x, len(bad))
        seen = hit & (grow | prune)
        if seen.sum() < least_rows or (bad[seen].sum() + 1) / (seen.sum() + 2) < precision:
            break
        rules.append(rule)
        grow &= ~hit
        prune &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, else 0."""
    out = None
    for number, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for test in rule[1:]:
            hit = hit & test.column()
        out = F.when(hit, F.lit(number)) if out is None else out.when(hit, F.lit(number))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, id_col: str, key: str,
                    most: int = TRAIN_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels of at most ``most`` labelled rows, smallest id hash first."""
    marks = hash_sample(labels.select(F.col(id_col).alias(key), F.col(label).alias("_label")).dropna(), key, most)
    found = (rows.join(marks, key).withColumn("_o", F.xxhash64(key))
             .orderBy("_o", key, *FEATURES, "_label").limit(most).select(*FEATURES, "_label").collect())
    x = {f: np.array([r[f] for r in found], float) for f in FEATURES}
    return x, np.array([r["_label"] for r in found], np.int64)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label: str = "quality") -> DataFrame:
    """``<id_col>``, the counts of every text, ``base_failed``, ``rule`` and ``kept``.

    A text of fewer than ten words, or of which more than a fifth lies in
    repeated five-word windows, fails outright; of the others those that a
    learned rule covers go.  Null text is empty (and fails); rows with equal
    ids are judged one by one and each counts as labelled if the id is; null
    labels are not learned from; without labels no rule is learned; an empty
    table gives no rows; other columns of ``docs`` are not read."""
    rows = cut(measured(docs, [id_col], text_col), "measures").withColumns(ratios())
    x, y = labelled_sample(rows, labels, label, id_col, "k0")
    rules = learn(x, y == 0) if len(y) else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (rows.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("k0", id_col))

"""Quality classifier with hierarchical empirical Bayes (op 4).

A logistic model gives every document's own evidence.  Sites (hosts) and paths
within them get a posterior rate of good documents: labels where there are
any, the model's probability elsewhere, shrunk from path to host and from host
to the whole corpus by weights that come from the spread between the groups
(method of moments).  The document's evidence and its path's posterior are
then added on the log-odds scale.  A document's own label and evidence are taken
out of the rates of its path and host first, so that nothing counts twice and no
label scores itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import cut
from ledgerlight.llm.decision_list import TRAIN_ROWS, labelled_sample
from ledgerlight.llm.features import FEATURES, measured, ratios

LOGIT_LIMIT = 12.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(x: dict[str, np.ndarray], y: np.ndarray) -> Column:
    """The fitted log-odds as a Spark expression over the features.  Features
    also enter as squares, so that both ends of a measure can count."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return F.lit(float(np.log(rate / (1 - rate))))
    cols = {f: (v.mean(), v.std() or 1.0) for f, v in x.items()}
    z = {f: np.clip((x[f] - m) / s, -4, 4) for f, (m, s) in cols.items()}
    w = fit_logistic(np.column_stack([z[f] for f in FEATURES] + [z[f] ** 2 for f in FEATURES]), y.astype(float))
    out = F.lit(float(w[0]))
    for i, f in enumerate(FEATURES):
        m, s = cols[f]
        v = F.least(F.greatest((F.col(f) - float(m)) / float(s), F.lit(-4.0)), F.lit(4.0))
        out = out + v * float(w[1 + i]) + v * v * float(w[1 + len(FEATURES) + i])
    return F.least(F.greatest(out, F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def prior_weight(groups: DataFrame, mean: float) -> float:
    """Pseudo-rows of the prior, from how far group rates spread beyond chance."""
    s = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("g"),
                   F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2).alias("ss")).first()
    if not s["g"] or s["g"] < 2 or s["n"] <= s["g"]:
        return 10.0
    noise = mean * (1 - mean)
    spread = (s["ss"] - (s["g"] - 1) * noise) / (s["n"] - s["n2"] / s["n"])
    return float(np.clip(noise / spread - 1, 1.0, 1e4)) if spread > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``<id_col>, host, path, evidence, host_rate, path_rate, quality, keep``.

    ``host`` and ``path`` are expressions over ``docs``; null ones form a group
    of their own.  The model is fitted on at most ``train_rows`` labelled rows;
    group rates count every row but the one that is scored.  Null text is empty; a label that is null or
    absent is replaced by the model's probability; of several labels for one
    id the smallest counts; without labels all scores are even; an empty table
    gives no rows."""
    docs = docs.withColumns({"_host": F.coalesce(host.cast("string"), F.lit("\0")),
                             "_path": F.coalesce(path.cast("string"), F.lit("\0"))})
    rows = cut(measured(docs, [id_col, "_host", "_path"], text_col), "measures").withColumns(ratios())
    x, y = labelled_sample(rows, labels, label, id_col, "k0", train_rows)
    marks = labels.select(F.col(id_col).alias("k0"), F.col(label).alias("_y")).dropna().groupBy("k0").agg(F.min("_y").alias("_y"))
    scored = (rows.withColumn("evidence", evidence(x, y)).select("k0", "k1", "k2", "evidence")
              .join(marks, "k0", "left"))
    scored = cut(scored.withColumn("_good", F.coalesce(F.col("_y").cast("double"), 1 / (1 + F.exp(-F.col("evidence"))))), "evidence")
    paths = cut(scored.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("good")), "paths")
    hosts = paths.groupBy("k1").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = float(((whole["good"] or 0.0) + 1) / ((whole["n"] or 0) + 2))
    k_host, k_path = prior_weight(hosts, mean), prior_weight(paths, mean)
    sites = paths.join(hosts.select("k1", F.col("n").alias("_hn"), F.col("good").alias("_hg")), "k1")
    # Without the row itself.
    host_rate = (F.col("_hg") - F.col("_good") + k_host * mean) / (F.col("_hn") - 1 + k_host)
    path_rate = (F.col("good") - F.col("_good") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    odds = F.col("evidence") + logit(F.col("path_rate")) - float(np.log(mean / (1 - mean)))
    return (scored.join(sites, ["k1", "k2"]).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
            .withColumn("quality", 1 / (1 + F.exp(-odds)))
            .select(F.col("k0").alias(id_col), F.col("k1").alias("host"), F.col("k2").alias("path"), "evidence",
                    "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("keep")))

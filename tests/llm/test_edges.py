"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing
column names and an empty table."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import (decision_list, empirical_bayes, hilbert, mixing, packing, signature_join,
                             suffix_dedup, suffix_tree_lm, toxicity, winnowing)


def labels_of(spark, docs):
    return (docs.select("doc_id").withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
            .withColumn("toxic", F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id") % 2).cast("int")))


OPERATORS = {
    "mixing": lambda d, l: mixing.mix_documents(d, 100, max_repeats=2.0),
    "mixing_entropy": lambda d, l: mixing.mix_documents(d, 100, max_repeats=None, min_entropy=0.5, cover=False),
    "repeat": lambda d, l: mixing.repeat_documents(d, 1.5),
    "winnowing": lambda d, l: winnowing.fingerprint_edits(d),
    "suffix_tree": lambda d, l: suffix_tree_lm.score_texts(d, "doc_id % 3 = 0"),
    "empirical_bayes": lambda d, l: empirical_bayes.classify(d, l, F.col("source"), F.col("lang")),
    "suffix_dedup": lambda d, l: suffix_dedup.remove_repeats(d, 20),
    "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l), ["doc_id"]),
    "reject": lambda d, l: toxicity.reject_toxic(d, toxicity.Model([], [-9.0] + [0.0] * 6)),
    "signature_join": lambda d, l: signature_join.similar_groups(d),
    "packing": lambda d, l: packing.pack(d, 64),
    "decision_list": lambda d, l: decision_list.apply_rules(d, l),
    "hilbert": lambda d, l: hilbert.hilbert_shards(d, [hilbert.quantile_cells(d, F.octet_length("text"), 4), F.pmod(F.xxhash64("source"), F.lit(16))], 5),
}
ONE_PER_ROW = {"winnowing", "suffix_tree", "empirical_bayes", "suffix_dedup", "toxicity", "signature_join",
               "decision_list", "hilbert", "reject"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, edge, name):
    out = OPERATORS[name](edge, labels_of(spark, edge))
    rows = out.collect()
    if name in ONE_PER_ROW:
        assert len(rows) == edge.count()
    ids = {r["doc_id"] for r in rows}
    if name not in ("mixing_entropy",):
        assert ids == {r["doc_id"] for r in edge.select("doc_id").collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, no_labels, name):
    out = OPERATORS[name](empty, no_labels)
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", ["empirical_bayes", "toxicity", "decision_list"])
def test_no_labels(edge, no_labels, name):
    assert OPERATORS[name](edge, no_labels).count() == edge.count()


def test_equal_texts_get_equal_results(spark, edge):
    found = {r["doc_id"]: r for r in winnowing.fingerprint_edits(edge.filter("doc_id in (6, 7)").dropDuplicates(["doc_id"])).collect()}
    assert found[6]["fingerprint"] == found[7]["fingerprint"] and found[6]["near_next"] == 1.0
    groups = {r["doc_id"]: r["component_id"] for r in signature_join.similar_groups(edge).collect()}
    assert groups[7] == 6 and groups[1] == 1 and groups[None] is None

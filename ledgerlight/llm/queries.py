"""The registered queries of the corpus operators: each applies one operator,
with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import byte_gru, conversation_repair, decision_list, empirical_bayes, hilbert, mixing, packing, periodic_runs, signature_join, suffix_dedup, suffix_tree_lm, toxicity, winnowing
from ledgerlight.llm.common import id_crc, table


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at least once, no source more than twice, in blocks of 2**18 words."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"), block_tokens=1 << 18, max_repeats=2.0)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"), k=4, w=8)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree_lm.score_texts(
        table(spark, sf_dir, "documents"), "crc32(coalesce(cast(doc_id as string), '')) % 7 <> 2")
    return scored.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op4_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts, languages within a source the paths."""
    return empirical_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                    host=F.col("source"), path=F.col("lang"))


def op5_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))


def op6_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=id_crc() % 5 != 0)
    return (toxicity.score(docs, model, ["doc_id"]).withColumn("held_out", id_crc() % 5 == 0)
            .select("doc_id", "held_out", "score", "predicted"))


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=1024)


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = decision_list.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "rule")


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal row counts along a curve through size, source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    size = hilbert.quantile_cells(docs, F.octet_length("text"), 4)
    for out, column in (("_by_source", "source"), ("_by_lang", "lang")):
        docs = hilbert.with_category_cells(docs, F.col(column), 4, out)
    return (hilbert.hilbert_shards(docs, [size, F.col("_by_source"), F.col("_by_lang")], n_shards=16, bits=4)
            .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}))


def cover_runs(docs: DataFrame) -> DataFrame:
    """Runs of ``docs`` with planted periods, as the strongest run and digests."""
    found = periodic_runs.find_runs(periodic_runs.plant_periods(docs))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op11_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_runs(table(spark, sf_dir, "documents"))


def op12_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_gru.train(docs, usable=id_crc() % 3 != 1)
    return byte_gru.predict(docs, net).select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present=damaged["live"])


QUERIES = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op2_winnowing": op2_winnowing,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_empirical_bayes": op4_empirical_bayes,
    "op5_induced_suffixes": op5_induced_suffixes,
    "op6_levenshtein_toxicity": op6_levenshtein_toxicity,
    "op7_signature_trees": op7_signature_trees,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_decision_list": op9_decision_list,
    "op10_hilbert": op10_hilbert,
    "op11_cover_runs": op11_cover_runs,
    "op12_byte_gru": op12_byte_gru,
    "op13_auction_repair": op13_auction_repair,
}
ORACLES: dict[str, str] = {}

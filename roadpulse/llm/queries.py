"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.llm import alignment, conversation_repair, mixing, neighbours, packing, quality_rules, recompression, secret_scan, simhash, suffix_dedup, suffix_tree_lm, toxicity, word_table
from roadpulse.llm.common import documents

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at most twice as often as the rarest-read one; whole epochs for all."""
    return mixing.mix(documents(spark, sf_dir), repetition_limit=2.0).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


@query
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("clean_text")


ORACLES["op6_line_rules"] = quality_rules.oracle()


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_texts(documents(spark, sf_dir))


@query
def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(documents(spark, sf_dir))


@query
def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(documents(spark, sf_dir))


@query
def op13_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

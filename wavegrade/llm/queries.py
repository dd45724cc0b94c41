"""The registered queries of the training-data operators and the SQL that says what their results are."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrade.llm import bpe_count, curve_pack, fm_decontaminate, grid_codes, language_fusion, lbl_score, line_rules, oracles, pii_semicrf, quality_rff, simhash_bk, suffix_dedup, table_means, tiered_shards
from wavegrade.llm.common import folded, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_semicrf.find(docs, pii_semicrf.fit(docs))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, sf_dir, docs)
    return quality_rff.score(docs.select("doc_id", "text"), model, ["doc_id"], "text").select("doc_id", (folded("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_rff.Model:
    learn = folded("doc_id", 4) != 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(learn)
    return quality_rff.fit(docs.select("doc_id", "text").where(learn), labels, calibrate=folded("doc_id", 4) == 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(table(spark, sf_dir, "documents"), with_text=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_score.score(table(spark, sf_dir, "documents"), folded("doc_id", 5) != 1)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_fusion.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_shards.placed(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_means.cluster(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_quality_classifier, op3_quality_rules, op4_token_counts, op5_lm_scoring, op6_simhash_near_dedup, op7_language_id, op8_sharding, op9_benchmark_decontamination, op10_packing, op11_vector_codes, op12_centroid_clustering, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL

"""The queries of the operators over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apertura.llm import decontamination, fill_in_middle, html_crf, importance, lang_cnn, mixing, piece_bpe, quality_mil, secret_scan, sharding, superminhash, url_rules, vector_neighbours
from apertura.llm.shared import table


def op1_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over shingles of four words, as the query's contract has it; the operator takes five unless told otherwise."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.identified(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digest(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_neighbours": op1_vector_neighbours,
        "op2_main_text": op2_main_text,
        "op3_mix_sources": op3_mix_sources,
        "op4_quality": op4_quality,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_url_rules": op6_url_rules,
        "op7_language": op7_language,
        "op8_decontamination": op8_decontamination,
        "op9_shards": op9_shards,
        "op10_secrets": op10_secrets,
        "op11_pieces": op11_pieces,
        "op12_importance": op12_importance,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_neighbours": vector_neighbours.NEIGHBOURS_SQL,
        "op3_mix_sources": mixing.MIX_SQL,
        "op5_near_duplicates": superminhash.NEAR_DUPLICATES_SQL,
        "op6_url_rules": url_rules.URL_SQL,
        "op13_fill_in_middle": fill_in_middle.FIM_SQL,
    }

"""Queries of this subpackage and their SQL; the repository's entry module adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, ctw, decontam, exact_dedup, language_id, licenses, merkle, minhash_forest, mixing, quality, secrets, suffix_dedup, whitening
from .common import read_table


def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_classes(read_table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.language_model_report(read_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"), licenses.notices(spark))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string"
    )
    return chat.chat_report(rows.unionByName(probe))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(read_table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_join": op1_near_join,
    "op2_context_tree": op2_context_tree,
    "op3_licenses": op3_licenses,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_repeats": op8_repeats,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op1_near_join": minhash_forest.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_repeats": suffix_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_decontamination": decontam.ORACLE,
    "op13_manifest": merkle.ORACLE,
}

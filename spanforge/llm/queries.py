"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import chat, decontam, html_text, minhash, packing, quality, secrets, sharding, token_counts, token_orc
from spanforge.llm.common import table, work_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token_orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_orc.digests(spark, path)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_trap(spark, table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_html_extraction, op3_secret_scan, op4_sharding, op5_decontamination,
        op6_token_orc, op7_quality_rules, op8_minhash_dedup, op9_token_counts, op10_chat_format,
    )
}

ORACLES = {
    "op5_decontamination": decontam.oracle(),
    "op7_quality_rules": quality.oracle(),
    "op8_minhash_dedup": minhash.oracle(),
    "op10_chat_format": chat.oracle(),
}

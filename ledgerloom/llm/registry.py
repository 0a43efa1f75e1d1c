"""The queries opN_<name>: thin readers of whole tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import quality_rules

    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import pii

    return pii.summary(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import token_files
    from ledgerloom.llm.store import new_path

    folder = new_path(spark, "token-files")
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"))
    return token_files.read(spark, manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import decontaminate

    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import html_main

    return html_main.summary(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import quality_model

    return quality_model.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import licenses

    return licenses.summary(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import secrets

    return secrets.summary(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items(), key=lambda x: int(x[0][2:].split("_")[0]) if x[0][:2] == "op" and x[0][2].isdigit() else 0) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm import oracles

    return dict(oracles.SQL)

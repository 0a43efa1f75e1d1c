"""The corpus pipeline: its stages in order, each over all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.registry import table, tokenizer_file
from ledgerloom.llm.store import drop, recording, written

#: The tables between the steps of the last stage of each application.
_left: dict[str, list[str]] = {}


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage gets what the one before it returned from a written table, so the tables between the steps of that one
    are dropped first: a stage's result must be written, or used up, before the next stage is called."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop(spark, _left.pop(app, []))
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        _left[app] = made
        return out

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    from ledgerloom.llm import quality_rules

    return quality_rules.keep(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest doc_id."""
    from ledgerloom.llm import ngram_join

    return ngram_join.keep_one(docs)


@staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by benchmark items go."""
    from ledgerloom.llm import decontaminate

    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@staged
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays."""
    from ledgerloom.llm import secrets

    return secrets.redact(docs)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences."""
    from ledgerloom.llm import packing

    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("secret scans", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with recording() as made:
                docs = written(docs, f"stage-{k}")
            drop(spark, before)
            before = made
    return docs


#: The tokenizer and connected groups together are beyond SQL; tests hold run() against a brute-force version of the joins and
#: the packing, with the verdicts and the redaction of the operators, which have tests of their own.
ORACLE_SQL = None

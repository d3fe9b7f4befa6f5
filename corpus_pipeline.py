"""The corpus pipeline: each stage one operator, on all that the stage before it kept.

Quality rules, near-duplicate removal, secret redaction, mixing to target weights, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataleaf.llm import minhash_dedup, mixing, packing, quality_divergence, secret_scan
from strataleaf.llm.common import last_one_left, made, spent, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose distributions are those of their language; the others go."""
    return quality_divergence.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id."""
    return minhash_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the budgets of domains, languages and sources buy; a document comes once per epoch."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot in a sequence for every piece of every document: the columns of packing.packed."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express the signatures, the lexer or the planner; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again as the next one's input.

    What a stage leaves in that folder besides its result is deleted once the result is written, and the result once the
    next stage's is; what the last stage needs stays, for its rows are made when they are asked for.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since = made()
        docs = last_one_left(written(stage(spark, docs, sf_dir), name), since)
        if before is not None:
            spent(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

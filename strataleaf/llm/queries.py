"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataleaf.llm import chat_format, jpeg_media, license_scan, minhash_dedup, mixing, packing, quality_divergence, secret_scan, url_filter, warc_derive
from strataleaf.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.sql(url_filter.LIST_SQL.replace("FROM pages", "FROM {pages}"), pages=pages)
    return url_filter.marked(pages, listed).select("page_id", "canonical_url", "listed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.decisions(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = jpeg_media.from_embeddings(table(spark, sf_dir, "embeddings"))
    return jpeg_media.decoded(media, "vec_id")


def op10_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derived(warc_derive.responses(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_divergence": op6_quality_divergence,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_mix_sources": op8_mix_sources,
        "op9_jpeg_media": op9_jpeg_media,
        "op10_warc_derive": op10_warc_derive,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op2_license_scan": license_scan.sql(),
        "op6_quality_divergence": quality_divergence.SQL,
        "op8_mix_sources": mixing.SQL,
        "op10_warc_derive": warc_derive.sql(),
    }

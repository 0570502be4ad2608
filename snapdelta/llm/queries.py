"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import chat_rotation, curve_packing, license_scan, minhash, quality_rules, sentencepiece_codec, simhash_dedup, site_classifier, url_filter, warc_source
from snapdelta.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")
    return sentencepiece_codec.transcode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], emit=digests)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat_rotation.rotate(table(spark, sf_dir, "conversations"))
    return rendered.withColumn("masks", chat_rotation.spans(rendered.masks))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_site_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    warc_source.dedupe_and_write(table(spark, sf_dir, "pages"), folder)
    return warc_source.pages_back(spark, folder)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_report(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    own = (op1_sentencepiece, op2_simhash_dedup, op3_chat_rotation, op4_quality_rules, op5_url_filter, op6_curve_packing, op7_site_classifier, op8_warc, op9_minhash, op10_license_scan)
    return {f.__name__: f for f in own} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """The other operators are tested against brute force, exact round trips or held-out labels in tests/llm."""
    return {"op3_chat_rotation": chat_rotation.ORACLE, "op4_quality_rules": quality_rules.oracle(), "op8_warc": warc_source.ORACLE}

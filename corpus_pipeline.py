"""A training-data pipeline of four stages over the documents table.

Each stage takes what its predecessor kept, as a table; all but the last return the columns of
documents. Part of the subpackage ``llm``.

Defined cases, in every stage: null text is empty, texts of any length are taken whole, rows with null or
repeated ids and repeated rows are documents of their own (near-duplicates of each other, where their texts
are), null and empty languages and sources are apart from each other, further columns of any name are
carried through, and an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import curve_packing, quality_rules, simhash_dedup, site_classifier
from snapdelta.llm.common import drop_written, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site classifier keeps. Without labels of both kinds it keeps all."""
    return site_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; texts too short for a histogram are judged by the base rules alone."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of those the first fingerprint.

    A group whose ids are all null leaves one as well.
    """
    return simhash_dedup.keep_one_per_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left; an empty text is its end id."""
    return curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_filter), ("simhash near-dedup", near_dedup), ("packing", packing)]

#: The classifier's weights, the 64-bit hashes and the tokenizer have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: language ID, quality rules, near-duplicate removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept and returns a DataFrame;
``run`` writes it as Parquet to the shared folder and hands the written rows to the next stage. All stages but the
last return rows of ``documents`` with all their columns as they are. Stages never look at columns they don't name,
so further columns, whatever their names, go along. An empty table passes through every stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from panelspark.llm import bpe, decontaminate, langid, quality_rules, simhash  # noqa: E402
from panelspark.llm.common import table  # noqa: E402
from panelspark.session import ship, stage  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with enough confidence; those without a letter or with a null text go."""
    ship(spark)
    return langid.keep_accepted(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail no quality rule, the rules in the order measured on these rows."""
    ship(spark)
    return quality_rules.keep_good(docs, quality_rules.order(quality_rules.measure(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't hold benchmark passages beyond the contamination rule."""
    ship(spark)
    return decontaminate.keep_clean(docs, decontaminate.Strings(table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and token ids of every row; every text is decoded again and compared (column round_trip)."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, passed=("doc_id", "lang"), whole=False)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_level_bpe", tokens),
]

#: Language ID and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""A training corpus from raw documents: quality, language, near duplicates, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before
has kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import langid, near_dups, packing, quality
from tidecast.llm.common import read, written

#: No SQL: two stages are trained models. ``tests/llm/test_pipeline.py`` has a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field calls good; it learns from the labels of ``docs``."""
    return quality.good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` name; text without letters and text far from all of them goes."""
    return langid.accepted(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of copies and near copies."""
    return near_dups.distinct_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

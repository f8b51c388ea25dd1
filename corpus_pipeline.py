"""Corpus preparation over ``documents`` in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again: documents that
the quality classifier rejects go, then those without a clear language, then all but one of
each class of near copies; the mix takes each source's documents zero, one or two times, and what it takes is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import chosenpath, common, langid, mixing, packing, quality
from skyledger.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepared(spark)
    return quality.keep(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepared(spark)
    return langid.keep(docs, langid.train(docs))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepared(spark)
    return chosenpath.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepared(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepared(spark)
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"), end=2, drops_space=False)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_copies", keep_one_of_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained models, genetic packing and random rounding are beyond SQL; the tests compare with
# plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the pieces of the packed sequences."""
    docs = common.table(common.prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

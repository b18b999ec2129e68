"""The corpus pipeline: STAGES applied to ``documents`` one after another.

Quality classifier, exact dedup, near-dedup, mixing to target weights, packing.
Every stage reads what the one before has written; the temporary tables of a
stage are deleted when the next one begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import exact_dedup, minhash, mixing, packing, quality
from cohortspark.llm.common import materialise, release, table

#: Shares of tokens after mixing, of documents that passed the quality classifier.
TARGET = {"good": 0.93, "toxic": 0.07, "junk": 0.0}


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.apply_rates(docs, table(spark, sf_dir, "labels"), TARGET)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES = [("quality classifier", good), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither the trained classifier nor signatures, rates or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
    return docs

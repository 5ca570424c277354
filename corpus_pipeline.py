"""A corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` lands
what each stage returns as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curalens.llm.common import landed, table
from curalens.llm.minhash_dedup import keep_one_of_each
from curalens.llm.packing import pack_documents
from curalens.llm.quality_rules import keep_quality
from curalens.llm.queries import WORD_FILE
from curalens.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples speak against label 1."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, in sequences of at most 2,048 tokens."""
    return pack_documents(docs, WORD_FILE)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("best-fit packing", packing)]

#: Model scores and tokenizer ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

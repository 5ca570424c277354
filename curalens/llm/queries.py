"""Registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curalens.llm.byte_bpe import encoding_digests
from curalens.llm.common import table
from curalens.llm.id_files import id_file_digests
from curalens.llm.lm_scoring import score_texts
from curalens.llm.minhash_dedup import near_duplicates
from curalens.llm.packing import pack_documents
from curalens.llm.page_text import ARTICLE_SQL, page_text
from curalens.llm.quality_rules import VERDICT_SQL, quality_verdicts
from curalens.llm.ranked_search import RANKED_SQL, ranked_search
from curalens.llm.sharding import shard_documents
from curalens.llm.token_counts import token_counts
from curalens.llm.toxicity import score_toxicity
from curalens.llm.vector_dedup import near_vectors
from curalens.llm.whitening import whiten

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

BYTE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near-equal bytes (law ``bytes``), equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens, none but the over-long ones cut."""
    return pack_documents(table(spark, sf_dir, "documents"), WORD_FILE)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), BYTE_FILE, public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_FILE)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to bit-packed files of ids and read back."""
    return id_file_digests(table(spark, sf_dir, "documents"), WORD_FILE)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first 32 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_toxicity, op4_page_text, op5_vector_dedup, op6_packing, op7_byte_bpe, op8_quality_rules, op9_minhash_dedup,
                                  op10_token_counts, op11_ranked_search, op12_id_files, op13_whitening)}
SQL: dict[str, str] = {"op4_page_text": ARTICLE_SQL, "op8_quality_rules": VERDICT_SQL, "op11_ranked_search": RANKED_SQL}

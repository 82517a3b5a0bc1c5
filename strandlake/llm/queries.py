"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import oracles, quality_rules
from strandlake.llm.common import table
from strandlake.llm.embedding_dedup import near_vectors
from strandlake.llm.hilbert_shards import BITS, shard
from strandlake.llm.jaccard_join import jaccard_groups
from strandlake.llm.line_dedup import digest, line_dedup
from strandlake.llm.packing import pack
from strandlake.llm.piece_codec import encode_decode
from strandlake.llm.quality_classifier import quality_scores
from strandlake.llm.suffix_dedup import suffix_digest
from strandlake.llm.token_counts import token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORDS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORDS).drop("ids")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(line_dedup(table(spark, sf_dir, "documents")))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), PIECES)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "standard-2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop("curve")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_packing, op4_quality_classifier, op5_embedding_near_dedup, op6_line_dedup, op7_piece_codec, op8_jaccard_join, op9_quality_rules, op10_sharding)}
ORACLES = {"op1_suffix_dedup": oracles.SUFFIX_DEDUP, "op5_embedding_near_dedup": oracles.NEAR_VECTORS, "op8_jaccard_join": oracles.JACCARD, "op9_quality_rules": quality_rules.ORACLE, "op10_sharding": oracles.sharding(BITS)}

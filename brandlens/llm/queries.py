"""The queries of this package: one ``opN_`` per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles, op01_mixing, op02_likelihood, op03_tokens, op04_lattice_hash, op05_sharding, op06_weak_labels, op07_near_dedup, op08_language, op09_rules, op10_pieces, op11_rope_infill, op12_weighted_sampling


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_likelihood.score(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_tokens.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_e8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_lattice_hash.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_sharding.shard(_docs(spark, sf_dir))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_weak_labels.classify(_docs(spark, sf_dir))


def op7_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_near_dedup.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_language.identify(_docs(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", *op09_rules.BASE, "base_failed", "kept")
    return op09_rules.apply_rules(_docs(spark, sf_dir).select("doc_id", "text")).select(*columns)


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pieces.digest(op10_pieces.encode(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def op11_rope_infill_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_rope_infill.digest(_docs(spark, sf_dir))


def op12_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_weighted_sampling.edited_fingerprints(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pareto_mix, op2_lattice_likelihood, op3_transducer_counts, op4_e8_near_vectors, op5_sampled_splitters, op6_weak_label_quality, op7_hamming_near_dedup, op8_language_svm, op9_quality_rules, op10_unigram_pieces, op11_rope_infill_digests, op12_weighted_fingerprints)
}
ORACLE: dict[str, str] = oracles.ORACLE

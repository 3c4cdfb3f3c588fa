"""The training-data pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Every stage takes nulls in any column, empty and very
long texts (read whole), repeated rows, and further columns of any names, which stay; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm import op01_mixing, op07_near_dedup, op08_language, op09_rules, op10_pieces
from brandlens.llm.storage import Stash

PIECES = "piece_bpe_32k.model"
#: Words of a shingle in this stage; the two words of op07_near_dedup.SHINGLE are those of the query op7_ only.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, from models trained on the labelled rows that are not held out.

    Null and empty texts and those without letters go; a null lang is no label; repeated rows stay or go together.
    """
    return op08_language.keep_documents(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table. Null and empty texts fail it; repeated rows stay or go together."""
    return op09_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles: the one with the smallest id.

    Texts without words link with nothing and stay; rows that repeat an id and text are one document; a null id is
    never the smallest.
    """
    return op07_near_dedup.keep_documents(docs, size=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; texts without words have size 0 and are only copied whole; repeated rows rank
    alike, and as many are taken as fit.
    """
    return op01_mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and counts of each document of the mix; null and empty texts have no pieces."""
    return op10_pieces.encode(docs, public_tokenizers.path(PIECES)).withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Trained classifiers and subword encoding are not expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash.put(name, stage(spark, docs, sf_dir))
    return docs

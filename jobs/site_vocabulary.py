"""What each site talks about, and which of it the assistant's answers take up.

Reads pages of text (doc_id, text, source: the site) and conversations, and writes under the output folder

- ``term/site=S``: rank, term, score, document_frequency, occurrences, answers (that hold the term), covered;
- ``summary/site=S``: pages, words, terms, covered_terms, gap_terms (the ranked terms that no answer holds).

Both are replaced for the sites of a run only (dynamic partition overwrite): a run over some sites leaves the others,
and a run again leaves the same rows. A site that no longer has pages keeps what was written last. ``ranked`` holds
the terms before they are looked for. Pages without a site belong to ``(none)``; null texts are empty.

    python -m jobs.site_vocabulary --documents DIR --turns DIR --out DIR [--config jobs/site_vocabulary.json]
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.functions import text as T
from brandlens.operators import tagcloud

from .common import command_line, prepare, read_table

log = logging.getLogger("jobs.site_vocabulary")

NO_SITE = "(none)"
TERM = "rank long, term string, score double, document_frequency long, occurrences long, answers long, covered boolean, site string"
SUMMARY = "pages long, words long, terms long, covered_terms long, gap_terms array<string>, site string"


def pages_of(documents: DataFrame, sites: Sequence[str] | None) -> DataFrame:
    pages = documents.select(F.coalesce("source", F.lit(NO_SITE)).alias("site"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return pages.where(F.col("site").isin(list(sites))) if sites else pages


def answer_counts(turns: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, answers): how many assistant turns hold each of the terms as a token. Only tokens that some site ranks are
    grouped; the ranked terms are a top list a site."""
    said = turns.where("role = 'assistant' AND text IS NOT NULL")
    tokens = said.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("answers"))


def run(spark: SparkSession, documents: str, turns: str, out: str, top: int = tagcloud.SITE_TOP, sites: Sequence[str] | None = None) -> dict[str, int]:
    """Writes both tables for the sites (all by default); the counts that it logs."""
    pages = pages_of(spark.read.parquet(documents), sites)
    for table, schema in (("term", TERM), ("summary", SUMMARY)):
        prepare(spark, f"{out}/{table}", schema, ["site"])
    _replace(tagcloud.site_tagcloud(pages, top).withColumn("answers", F.lit(0).cast("long")).withColumn("covered", F.lit(False)), f"{out}/ranked")
    ranked = read_table(spark, f"{out}/ranked", TERM).drop("answers", "covered")
    ranked = ranked.where(F.col("site").isin(list(sites))) if sites else ranked
    counted = ranked.join(answer_counts(spark.read.parquet(turns), ranked), "term", "left")
    answers = F.coalesce("answers", F.lit(0).cast("long"))
    _replace(counted.withColumn("answers", answers).withColumn("covered", answers > 0), f"{out}/term")

    terms = read_table(spark, f"{out}/term", TERM)
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"))
    gap = F.when(~F.col("covered"), F.struct("rank", "term"))
    listed = terms.groupBy("site").agg(F.count("*").alias("terms"), F.count_if("covered").alias("covered_terms"), F.sort_array(F.collect_list(gap)).alias("gaps"))
    summary = totals.join(listed, "site", "left").select(
        "pages", "words", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "covered_terms")],
        F.coalesce(F.col("gaps.term"), F.array().cast("array<string>")).alias("gap_terms"), "site",
    )
    _replace(summary, f"{out}/summary")
    done = read_table(spark, f"{out}/summary", SUMMARY)
    done = done.where(F.col("site").isin(list(sites))) if sites else done
    row = done.agg(F.count("*"), F.sum("pages"), F.sum("terms")).first()
    counts = {"sites": row[0], "pages": row[1] or 0, "terms": row[2] or 0}
    log.info("read %d pages of %s and turns of %s; wrote %d terms of %d sites to %s", counts["pages"], documents, turns, counts["terms"], counts["sites"], out)
    return counts


def _replace(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the sites in rows; a site's rows (a top list) are one file."""
    rows.repartition("site").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def output(spark: SparkSession, out: str) -> DataFrame:
    """All ranked terms, with their site's numbers."""
    numbers = read_table(spark, f"{out}/summary", SUMMARY).select("site", "pages", "words", "covered_terms", F.array_join("gap_terms", " ").alias("gap_terms"))
    return read_table(spark, f"{out}/term", TERM).join(numbers, "site")


if __name__ == "__main__":
    command_line(run, "site_vocabulary", ("documents", "turns", "out"))

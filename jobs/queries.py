"""The jobs as queries: each runs twice over the whole tables into one new folder and returns what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brandlens.plans import catalog, oracles
from brandlens.sources.scratch import new_folder

from . import answer_mentions, site_vocabulary


def job1_answer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    # A pattern, as a stream does not take the path of a single file, which the table may be.
    turns = f"{sf_dir}/conversations.parquet*"
    for _ in range(2):
        answer_mentions.run(spark, turns, f"{folder}/out", f"{folder}/checkpoint", catalog.BRANDS)
    return answer_mentions.output(spark, f"{folder}/out")


def job2_site_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        site_vocabulary.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", f"{folder}/out")
    return site_vocabulary.output(spark, f"{folder}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_answer_mentions, job2_site_vocabulary)}

ORACLE = {
    "job1_answer_mentions": f"""WITH {oracles.MENTIONS}, total AS (SELECT count(*) AS run_count FROM runs),
numbers AS (SELECT brand, count(*) AS mention_count FROM mentions GROUP BY brand)
SELECT m.*, mention_count, run_count, round(mention_count::DOUBLE / run_count, 6) AS share_of_voice FROM mentions m JOIN numbers USING (brand), total""",
    "job2_site_vocabulary": f"""WITH {oracles.cloud(f"coalesce(source, '{site_vocabulary.NO_SITE}')")},
said AS (SELECT unnest(list_distinct({oracles.TOKENS})) AS term FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
heard AS (SELECT term, count(*) AS answers FROM said GROUP BY term),
ranked AS (SELECT c.*, coalesce(answers, 0) AS answers, coalesce(answers, 0) > 0 AS covered FROM cloud c LEFT JOIN heard USING (term) WHERE rank <= 50),
listed AS (SELECT site, count(*) FILTER (covered) AS covered_terms, coalesce(string_agg(term, ' ' ORDER BY rank) FILTER (NOT covered), '') AS gap_terms FROM ranked GROUP BY site),
totals AS (SELECT site, count(*) AS pages, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM pages_ GROUP BY site)
SELECT r.site, rank, term, score, document_frequency, occurrences, answers, covered, pages, words, covered_terms, gap_terms FROM ranked r JOIN listed USING (site) JOIN totals USING (site)""",
}

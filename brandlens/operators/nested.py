"""Rows with what belongs to them as ordered arrays: prompts with runs, hooks with questions, brands with those beside
them, themes with terms.

An array holds a page of at most ``page`` items; what is beyond is on the next row of the same key (``page`` counts
from 0), so that a key with very many items is no single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import number

PAGE = 200
#: Characters of an answer that a list of runs shows.
SHOWN = 220


def paged(items: DataFrame, key: str, order: Sequence[str | Column], value: Column, name: str, page: int = PAGE) -> DataFrame:
    """(key, page, n, name): the items of each key in order, in arrays of at most ``page``; n is the key's number of items.

    Items are numbered over all keys at once, by ranges, so one key's items need not fit a task.
    """
    placed = number(items.select("*", value.alias("_value")), key, *order, name="_n", start=0)
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_first"), F.count("*").alias("n"))
    at = (F.col("_n") - F.col("_first")).alias("_at")
    pages = placed.join(first, F.col(key) == F.col("_key")).select(key, "n", at, "_value").withColumn("page", F.floor(F.col("_at") / page).cast("long"))
    grouped = pages.groupBy(key, "page").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
    return grouped.select(key, "page", "n", F.transform("_all", lambda x: x["_value"]).alias(name))


def with_pages(rows: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    """rows, each with its pages; a row without items has one empty page."""
    kind = pages.schema[name].dataType
    joined = rows.join(pages, key, "left")
    empty = F.array().cast(kind)
    return joined.withColumn("page", F.coalesce("page", F.lit(0).cast("long"))).withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn(name, F.coalesce(name, empty))


def shown(text: Column, limit: int = SHOWN) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def prompt_runs(prompts: DataFrame, runs: DataFrame, page: int = PAGE) -> DataFrame:
    """Prompts (prompt_id, ...) with their runs (prompt_id, run_id, text), by run_id: n runs and pages of (run_id, text)."""
    item = F.struct("run_id", shown(F.col("text")).alias("text"))
    return with_pages(prompts, paged(runs, "prompt_id", ["run_id"], item, "runs", page), "prompt_id", "runs")


def grouped_runs(runs: DataFrame, attributes: Sequence[str], page: int = PAGE) -> DataFrame:
    """Runs (ord, prompt_id, run_id, text, attributes) by prompt: the attributes of a prompt's first run, and its runs in
    order, by pages; ``place`` is the order of the prompts' first runs."""
    first = runs.groupBy("prompt_id").agg(F.min("ord").alias("_first"), *[F.min_by(c, "ord").alias(c) for c in attributes])
    item = F.struct("run_id", shown(F.col("text")).alias("text"))
    placed = number(first, "_first", name="place").drop("_first")
    return with_pages(placed, paged(runs, "prompt_id", ["ord"], item, "runs", page), "prompt_id", "runs")


def with_questions(rows: DataFrame, questions: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """Hooks or claims (key, ...) with the questions (key, ord, text) made of them, in order."""
    return with_pages(rows, paged(questions.select(key, "ord", "text"), key, ["ord"], F.col("text"), "questions", page), key, "questions")


def co_occurrence_lists(mentions: DataFrame, brands: DataFrame) -> DataFrame:
    """Each brand (brand, ...) with ``others``: (brand, count) of the brands named in the same runs, most runs first, then
    the one met first. mentions (run_ord, position, brand), one row a run and brand: the order of runs and of brands in a
    run; those without a run are left out.

    A run's list is a window over its rows, and a pair's first run and place are two numbers: neither rows nor pairs are
    sorted to be grouped.
    """
    every = F.collect_list(F.struct("position", "brand")).over(W.partitionBy("run_ord"))
    pairs = mentions.where("run_ord IS NOT NULL").select("run_ord", "brand", every.alias("all")).select("run_ord", "brand", F.explode("all").alias("b"))
    paired = pairs.where("b.brand <> brand").select("run_ord", "brand", F.col("b.brand").alias("other"), F.col("b.position").alias("position"))
    counted = paired.groupBy("brand", "other").agg(F.count("*").alias("count"), F.min("run_ord").alias("run"), F.min_by("position", "run_ord").alias("position"))
    counted = counted.select("brand", "other", "count", F.struct("run", "position").alias("met"))
    item = F.struct((-F.col("count")).alias("c"), "met", "other", "count")
    lists = counted.groupBy("brand").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    others = F.transform("_all", lambda x: F.struct(x["other"].alias("brand"), x["count"].alias("count")))
    kind = "array<struct<brand:string,count:bigint>>"
    return brands.join(lists, "brand", "left").withColumn("others", F.coalesce(others, F.array().cast(kind))).drop("_all")


def theme_lists(clustered: DataFrame) -> DataFrame:
    """(place, theme, total_score, terms) of clustered terms (theme, term, score, rank): themes by falling total, each
    with its terms by falling score, ties by rank, that is by first appearance."""
    item = F.struct((-F.col("score")).alias("s"), "rank", "term")
    themes = clustered.where("theme IS NOT NULL").groupBy("theme").agg(F.sum("score").alias("total_score"), F.min("rank").alias("_first"), F.sort_array(F.collect_list(item)).alias("_all"))
    named = themes.select("theme", F.round("total_score", 6).alias("total_score"), "_first", F.transform("_all", lambda x: x["term"]).alias("terms"))
    return number(named, F.desc("total_score"), "_first", name="place").select("place", "theme", "total_score", "terms")


def cluster_totals(clustered: DataFrame, other: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: themes and unclustered terms of a clustering and of another method's, questions in themes (theme, id) and
    runs that mention a theme (theme, runs_mentioning), summed over themes."""
    count = lambda df, to: df.agg(F.count_distinct("theme").alias(f"themes{to}"), F.count_if(F.col("theme").isNull()).alias(f"unclustered{to}"))
    parts = [count(clustered, ""), count(other, "_other"), questions.agg(F.count("*").alias("questions")), answers.agg(F.coalesce(F.sum("runs_mentioning"), F.lit(0)).cast("long").alias("answer_mentions"))]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")

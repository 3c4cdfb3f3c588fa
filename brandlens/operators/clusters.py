"""Themes of site terms, and what questions and answers say about them."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .questions import ARTIFACTS

#: Terms that a model groups, at most.
MODEL_TERMS = 50
# Themes and their keywords.
TAXONOMY = {
    "AI & Automation": "agent agents ai automate automation automated assistant workflow workflows bot bots worker workers",
    "Collaboration & Teams": "team teams collaborate collaboration collaborative share sharing sync member members comment comments workspace workspaces people",
    "Issue & Project Tracking": "issue issues project projects task tasks ticket tickets backlog sprint sprints roadmap triage bug bugs milestone milestones",
    "Integrations & Ecosystem": "integration integrations api apps marketplace plugin plugins connect webhook webhooks zapier slack github extension extensions",
    "Speed & Focus": "fast faster speed quick focus streamline streamlined efficient efficiency simple simplicity minimal",
    "Pricing & Plans": "price pricing plan plans free trial subscription billing credit credits cost enterprise tier tiers upgrade unlimited",
    "Security & Compliance": "security secure compliance sso encryption privacy gdpr soc audit permissions access authentication",
    "Docs & Knowledge": "docs documentation wiki notes knowledge template templates page pages content article articles",
    "Design & UX": "design ux ui interface intuitive clean beautiful aesthetic",
}


def taxonomy_table(spark: SparkSession, taxonomy: dict[str, str] = TAXONOMY) -> DataFrame:
    return spark.createDataFrame([(t, k) for t, ks in taxonomy.items() for k in ks.split()], "theme string, term string").dropDuplicates(["term"])


def cluster_terms(tagcloud: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(theme, term, score): a null theme is unclustered; artifacts are dropped."""
    return tagcloud.where(~F.col("term").isin(ARTIFACTS)).join(taxonomy, "term", "left").select("theme", "term", "score")


def candidate_terms(tagcloud: DataFrame, top: int = MODEL_TERMS) -> DataFrame:
    """The best terms of a tag cloud that are no artifacts: what a model is asked to group."""
    return tagcloud.where(~F.col("term").isin(ARTIFACTS)).orderBy(F.desc("score"), "term").limit(top)


def grouping_prompt(terms: Sequence[str]) -> str:
    """What a model is asked; its answer is read by parse_themes."""
    return (
        "Group these site terms into themes. Use only terms of the list, each at most once; leave out what fits nowhere.\n"
        'Answer with JSON only: {"themes": [{"name": "...", "terms": ["..."]}], "unclustered": ["..."]}\n'
        "Terms: " + ", ".join(terms)
    )


def parse_themes(text: str | None) -> list[tuple[str, str, int]]:
    """(theme, term, ord) of a model's answer: an object with lists ``themes`` and ``unclustered``, perhaps in a code
    fence. An answer of another shape gives none."""
    fence = re.search(r"```(?:json)?\s*([\s\S]*?)```", text or "")
    try:
        found = json.loads((fence.group(1) if fence else text or "").strip())
        if not isinstance(found, dict) or not isinstance(found.get("themes"), list) or not isinstance(found.get("unclustered"), list):
            return []
        pairs = [(str(t["name"]), str(x)) for t in found["themes"] for x in t["terms"]]
    except (ValueError, KeyError, TypeError):
        return []
    return [(name, term, i) for i, (name, term) in enumerate(pairs)]


def cluster_terms_by_model(tagcloud: DataFrame, answer: str | None, top: int = MODEL_TERMS) -> DataFrame:
    """Like cluster_terms, with themes from a model: invented terms are dropped, the first theme to claim a term has it."""
    spark = tagcloud.sparkSession
    claims = spark.createDataFrame(parse_themes(answer), "theme string, term string, ord int")
    first = claims.withColumn("k", F.row_number().over(W.partitionBy("term").orderBy("ord"))).where("k = 1").select("theme", "term")
    best = candidate_terms(tagcloud, top)
    return best.join(first, "term", "left").select("theme", "term", "score")


ANSWER = "struct<themes:array<struct<name:string,terms:array<string>>>,unclustered:array<string>>"


def cluster_terms_by_models(clouds: DataFrame, answers: DataFrame, key: str = "site", text: str = "text", top: int = MODEL_TERMS) -> DataFrame:
    """``cluster_terms_by_model`` for many sites at once: (key, theme, term, score) from tag clouds (key, term, score) and
    one answer (key, text) each. An answer of another shape, perhaps in a code fence, claims nothing."""
    said = answers.select(key, F.from_json(T.strip_code_fence(F.col(text)), ANSWER).alias("a")).where("a.themes IS NOT NULL AND a.unclustered IS NOT NULL")
    claims = said.select(key, F.posexplode("a.themes").alias("i", "t")).select(key, "i", F.col("t.name").alias("theme"), F.posexplode("t.terms").alias("j", "term"))
    first = claims.where("theme IS NOT NULL").groupBy(key, "term").agg(F.min_by("theme", F.struct("i", "j")).alias("theme"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "term"))
    best = clouds.where(~F.col("term").isin(ARTIFACTS)).withColumn("k", place).where(F.col("k") <= top)
    return best.join(first, [key, "term"], "left").select(key, "theme", "term", "score")


def themes(clustered: DataFrame) -> DataFrame:
    """(theme, total_score, n_terms) by falling score."""
    return clustered.where("theme is not null").groupBy("theme").agg(F.sum("score").alias("total_score"), F.count("*").alias("n_terms")).orderBy(F.desc("total_score"), "theme")


def _listed(clustered: DataFrame) -> DataFrame:
    """One row: ``themes``, an array of (theme, terms), for rows that look for them in place. Terms are top lists."""
    per = clustered.where("theme is not null").groupBy("theme").agg(F.collect_set("term").alias("terms"))
    return F.broadcast(per.agg(F.collect_list(F.struct("theme", "terms")).alias("themes")))


def theme_questions(clustered: DataFrame, questions: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(theme, id) where any token of the question is a term of the theme."""
    tokens = questions.select(id, T.tokenize(F.col(text)).alias("_tokens")).crossJoin(_listed(clustered))
    named = F.filter("themes", lambda t: F.arrays_overlap("_tokens", t["terms"]))
    return tokens.select(F.explode(F.transform(named, lambda t: t["theme"])).alias("theme"), id).distinct()


#: Parts of a theme's runs that are counted apart before they are put together.
PARTS = 64


def theme_answers(clustered: DataFrame, runs: DataFrame, run: str = "run_id", text: str = "text", samples: int = 3) -> DataFrame:
    """(theme, runs_scanned, runs_mentioning, contexts): contexts of the first matching runs, in order of run.

    Every text looks for the terms in place: it is neither copied for each of its tokens nor leaves its task.
    """
    good = runs.where(F.col(text).isNotNull())
    listed = _listed(clustered)
    tokens = good.select(run, text, T.tokenize(F.col(text)).alias("_tokens")).crossJoin(listed)
    hits = tokens.select(run, text, F.explode(F.transform("themes", lambda t: F.struct(t["theme"].alias("theme"), F.array_intersect(t["terms"], "_tokens").alias("terms")))).alias("t")).where(F.size("t.terms") > 0)
    first = F.array_min(F.transform("t.terms", lambda x: F.struct(F.instr(F.lower(text), x).alias("ix"), x.alias("term"))))
    spots = hits.select(F.col("t.theme").alias("theme"), run, text, first.alias("m"))
    window = T.collapse(T.context_window(F.col(text), F.col("m.ix"), F.length("m.term")))
    best = spots.select("theme", run, "m", window.alias("context")).groupBy("theme", run).agg(F.min(F.struct("m", "context")).alias("b"))
    best = best.select("theme", run, F.col("b.context").alias("context"), F.pmod(F.xxhash64(run), F.lit(PARTS)).alias("part"))
    ranked = best.withColumn("k", F.row_number().over(W.partitionBy("theme", "part").orderBy(run)))
    shown = F.when(F.col("k") <= samples, F.struct(F.col(run).alias("run"), "context"))
    parts = ranked.groupBy("theme", "part").agg(F.count("*").alias("n"), F.collect_list(shown).alias("firsts"))
    firsts = F.slice(F.sort_array(F.flatten(F.collect_list("firsts"))), 1, samples)
    stats = parts.groupBy("theme").agg(F.sum("n").alias("runs_mentioning"), F.transform(firsts, lambda c: c["context"]).alias("contexts"))
    names = listed.select(F.explode("themes.theme").alias("theme"))
    n = good.agg(F.count("*").alias("runs_scanned"))
    return names.join(stats, "theme", "left").join(F.broadcast(n)).select("theme", "runs_scanned", F.coalesce("runs_mentioning", F.lit(0)).alias("runs_mentioning"), "contexts")


def treemap(clustered: DataFrame) -> DataFrame:
    return themes(clustered).select("theme", F.greatest(F.lit(1.0), F.col("total_score")).alias("size"), "n_terms")


def sankey(per_theme: DataFrame) -> DataFrame:
    """(source, target, value) from (theme, n_terms, has_question, has_mention): two hops a theme."""
    weight = F.greatest(F.lit(1), F.col("n_terms")).alias("value")
    asked = F.when(F.col("has_question"), "asked").otherwise("not asked")
    told = F.when(F.col("has_mention"), "mentioned").otherwise("not mentioned")
    hops = per_theme.select(F.col("theme").alias("source"), asked.alias("target"), weight).unionByName(per_theme.select(asked.alias("source"), told.alias("target"), weight))
    return hops.groupBy("source", "target").agg(F.sum("value").alias("value"))


def dashboard_totals(clustered: DataFrame) -> DataFrame:
    """(n_themes, n_unclustered) of one clustering."""
    return clustered.agg(F.countDistinct("theme").alias("n_themes"), F.count(F.when(F.col("theme").isNull(), 1)).alias("n_unclustered"))

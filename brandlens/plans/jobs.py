"""The four jobs over a lake: scrape, questions, aeo, clusters. Each reads and writes tables of one product."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, metrics, questions, report, site, tagcloud
from ..shipping import ship
from ..sources.call_log import CallLog
from ..sources.clients import Ask, Fetch, ask_model, crawl, replay
from ..sources.lake import Lake


class MissingInput(RuntimeError):
    """A table that a job needs is not in the lake."""


def _need(lake: Lake, product: str, *tables: tuple[str, str]) -> list[DataFrame]:
    found = [lake.read(*t) for t in tables]
    if missing := [f"{a}/{b}" for (a, b), df in zip(tables, found) if df is None]:
        raise MissingInput(f"Missing scraper output: {', '.join(missing)}")
    return [df.where(F.col("product") == product).drop("product") for df in found]


def _put(lake: Lake, product: str, layer: str, table: str, df: DataFrame) -> None:
    lake.write(layer, table, df, product)


def scrape(lake: Lake, product: str, entries: DataFrame, robots: str, fetch: Fetch, cap: int | None = 15, sitemap_xml: str | None = None, **politeness) -> None:
    """From sitemap entries (ord, url, priority): choose, fetch, parse once, and write all silver tables. ``politeness``
    is the crawl's: retries, timeout, delay, tasks."""
    spark = lake.spark
    ship(spark)
    if sitemap_xml is not None:
        lake.write_text("raw", f"sitemap/{product}.xml", sitemap_xml)
    rules = site.robots_rules(spark.createDataFrame([(product, robots)], "site string, content string"))
    chosen = site.quick_urls(entries, cap).select(F.col("pick").alias("ord"), "url") if cap else entries.select("ord", "url")
    allowed = site.robots_allowed(chosen.withColumn("site", F.lit(product)), rules).where("allowed")
    _put(lake, product, "raw", "page", crawl(allowed, fetch, **politeness))
    (pages,) = _need(lake, product, ("raw", "page"))
    good = site.ok_pages(pages)
    _put(lake, product, "extracted", "parsed", site.parsed(good))
    (parsed,) = _need(lake, product, ("extracted", "parsed"))
    _put(lake, product, "extracted", "seo_signal", site.seo_signals(parsed))
    _put(lake, product, "geo", "geo_signal", site.geo_signals(parsed))
    _put(lake, product, "extracted", "page_index", site.page_index(parsed, F.col("title")))
    texts = parsed.select(F.lit(product).alias("site"), F.col("url").alias("page"), "text")
    cloud = tagcloud.site_tagcloud(texts)
    _put(lake, product, "extracted", "tagcloud_site", cloud.drop("site"))
    _put(lake, product, "extracted", "tagcloud_page", tagcloud.page_tagcloud(texts).drop("site"))
    _put(lake, product, "extracted", "keyword_density", tagcloud.keyword_density(texts))
    _put(lake, product, "extracted", "phrase_cloud", tagcloud.phrase_cloud(texts, cloud.where(F.col("rank") <= tagcloud.PHRASE_TERMS)).drop("site"))
    _put(lake, product, "extracted", "sitemap_coverage", site.sitemap_coverage(entries, pages, chosen if cap else None))
    _put(lake, product, "extracted", "broken_url", site.broken_pages(pages))
    _put(lake, product, "extracted", "skipped_url", site.skipped_urls(entries, chosen if cap else None))


def make_questions(lake: Lake, product: str, brand: str, competitors: Sequence[str] = ()) -> str:
    """Hooks, claims and the questions made of them, as tables and as Markdown, which is returned."""
    seo, geo, cloud, phrases = _need(lake, product, ("extracted", "seo_signal"), ("geo", "geo_signal"), ("extracted", "tagcloud_site"), ("extracted", "phrase_cloud"))
    _put(lake, product, "questions", "hook", questions.scan_hooks(seo, geo, cloud, phrases, [brand]))
    (hooks,) = _need(lake, product, ("questions", "hook"))
    _put(lake, product, "questions", "hook_question", questions.hook_questions(hooks))
    # Sources one after the other, the pages of each in their order.
    told = lambda df, part, ord, url, text: df.select((F.lit(part << 40) + ord).alias("ord"), F.col(url).alias("url"), F.col(text).alias("text"))
    parts = [told(seo, 0, F.col("ord"), "url", "meta_description"), told(geo, 1, F.col("ord"), "url", "definition"), told(phrases, 2, F.col("pos"), "page", "snippet")]
    _put(lake, product, "questions", "claim", questions.scan_claims(reduce(DataFrame.unionByName, parts).where("text is not null"), [brand]))
    (claims,) = _need(lake, product, ("questions", "claim"))
    _put(lake, product, "questions", "inferential_question", questions.inferential_questions(claims, competitors))
    asked, inferred = _need(lake, product, ("questions", "hook_question"), ("questions", "inferential_question"))
    text = report.render_questions(brand, *[df.orderBy("ord").collect() for df in (hooks, asked, claims, inferred)])
    lake.write_text("questions", f"markdown/{product}.md", text)
    return text


def _measured(lake: Lake, product: str, prefix: str, good: DataFrame, names: Sequence[str], dims: DataFrame, dimensions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Writes mentions, metrics, co-occurrence and breakdown of runs under a prefix; the mentions and the metrics."""
    brands = metrics.brand_table(lake.spark, names)
    _put(lake, product, "aeo", f"{prefix}mention", metrics.extract_mentions(good, names))
    (found,) = _need(lake, product, ("aeo", f"{prefix}mention"))
    _put(lake, product, "aeo", f"{prefix}brand_metric", metrics.brand_metrics(found, good.count(), brands))
    _put(lake, product, "aeo", f"{prefix}dimension_breakdown", metrics.dimension_breakdown(dims, found, brands, dimensions))
    _put(lake, product, "aeo", f"{prefix}co_occurrence", metrics.co_occurrence(found))
    return found, _need(lake, product, ("aeo", f"{prefix}brand_metric"))[0]


def _asked(lake: Lake, product: str, log: str, prompts: DataFrame, ask: Ask, runs: int, **pacing) -> DataFrame:
    """The runs of prompts in a log of calls, after making those that are not in it."""
    calls = CallLog(lake.spark, f"{lake.path('aeo', 'call')}/product={product}/log={log}")
    calls.ask(prompts, ask, runs, **pacing)
    return calls.runs(prompts)


def grounded(lake: Lake, product: str, names: Sequence[str], ask: Ask, include: str, log: str, runs: int = 2, limit: int | None = None, **pacing) -> dict | None:
    """Asks the site's own questions (``include``: hooks, inferential or both) and measures the answers apart from the
    neutral runs; what the report shows of them."""
    wanted = [t for t, k in (("hook_question", "hooks"), ("inferential_question", "inferential")) if include in (k, "both")]
    found = dict(zip(wanted, _need(lake, product, *[("questions", t) for t in wanted])))
    asked = questions.question_prompts(found.get("hook_question"), found.get("inferential_question"), limit)
    _put(lake, product, "aeo", "brand_grounded_prompt", asked)
    (asked,) = _need(lake, product, ("aeo", "brand_grounded_prompt"))
    _put(lake, product, "aeo", "brand_grounded_run", _asked(lake, product, f"{log}-brand-grounded", asked, ask, runs, **pacing))
    good = metrics.successful(_need(lake, product, ("aeo", "brand_grounded_run"))[0])
    _, measured = _measured(lake, product, "brand_grounded_", good, names, good, ["source", "stage"])
    (breakdown,) = _need(lake, product, ("aeo", "brand_grounded_dimension_breakdown"))
    order = F.when(F.col("value") == "hook", 0).otherwise(1)
    return {"total": good.count(), "metrics": _in_order(measured, names), "breakdown": breakdown.orderBy("dimension", order, "value").collect()}


def _in_order(measured: DataFrame, names: Sequence[str]) -> list:
    rows = {r["brand"]: r for r in measured.collect()}
    return [rows[n] for n in dict.fromkeys(names)]


def audit(
    lake: Lake,
    product: str,
    brand: str,
    competitors: Sequence[str],
    category: str,
    ask: Ask,
    prompts: int = 10,
    runs: int = 3,
    include: str | None = None,
    question_runs: int = 2,
    question_limit: int | None = None,
    recorded: DataFrame | None = None,
    log: str | None = None,
    **pacing,
) -> str:
    """Ask (or take recorded runs), measure, and write the report; the Markdown is returned. ``include`` adds runs of the
    site's own questions, which touch neither scores nor priorities. An audit that ended halfway is taken up again by
    its ``log``: calls that are in the log of this name are not made again."""
    log = log or uuid.uuid4().hex
    seo, geo, cloud, broken = _need(lake, product, ("extracted", "seo_signal"), ("geo", "geo_signal"), ("extracted", "tagcloud_site"), ("extracted", "broken_url"))
    names = [brand, *competitors]
    asked = questions.generate_prompts(lake.spark, brand, competitors, category, prompts).withColumnRenamed("persona_role", "persona")
    _put(lake, product, "aeo", "prompt", asked)
    (asked,) = _need(lake, product, ("aeo", "prompt"))
    _put(lake, product, "aeo", "run", _asked(lake, product, log, asked, ask, runs, **pacing) if recorded is None else replay(recorded, asked))
    good = metrics.successful(_need(lake, product, ("aeo", "run"))[0])
    found, measured = _measured(lake, product, "", good, names, good, ["intent", "persona", "specificity", "attribute", "language"])
    _put(lake, product, "aeo", "geo_aeo_gap", metrics.geo_aeo_gaps(cloud, found, brand))
    (gaps,) = _need(lake, product, ("aeo", "geo_aeo_gap"))
    every = site.seo_findings(seo, broken).unionByName(site.geo_findings(geo)).unionByName(report.aeo_findings(measured, brand, gaps))
    _put(lake, product, "report", "finding", every)
    own = measured.where(F.col("brand") == brand).select(site.aeo_score(F.col("share_of_voice"), F.col("sentiment_score"))).first()
    scores = {"seo": seo.agg(site.seo_score(seo, broken.count())).first()[0], "geo": geo.agg(site.geo_score()).first()[0], "aeo": own[0] if own else 0}
    _put(lake, product, "report", "score", lake.spark.createDataFrame([(k, int(s), report.label(s)) for k, s in scores.items()], "dimension string, score long, label string"))
    apart = grounded(lake, product, names, ask, include, log, question_runs, question_limit, **pacing) if include else None
    facts = report.report_facts(seo, geo, broken, cloud, gaps)
    (findings,) = _need(lake, product, ("report", "finding"))
    text = report.render_report(brand, competitors, scores, facts, good.count(), _in_order(measured, names), site.prioritised(findings).collect(), apart, datetime.now(UTC).isoformat())
    lake.write_text("report", f"markdown/{product}.md", text)
    return text


def cluster(lake: Lake, product: str, ask: Ask | None = None) -> DataFrame:
    """(theme, term, score) by the taxonomy, or by a model's answer where one is asked; correlated tables are written."""
    (cloud,) = _need(lake, product, ("extracted", "tagcloud_site"))
    if ask is None:
        found = clusters.cluster_terms(cloud, clusters.taxonomy_table(lake.spark))
    else:
        terms = [r["term"] for r in clusters.candidate_terms(cloud).collect()]
        found = clusters.cluster_terms_by_model(cloud, ask_model(clusters.grouping_prompt(terms), ask)[0])
    _put(lake, product, "clusters", "theme_term", found)
    for table, name in (("hook_question", "hook"), ("inferential_question", "inferential")):
        asked = lake.read("questions", table)
        if asked is not None:
            _put(lake, product, "clusters", f"theme_{name}", clusters.theme_questions(found, asked.where(F.col("product") == product)))
    for table, name in (("run", "theme_answer"), ("brand_grounded_run", "theme_brand_grounded_answer")):
        runs = lake.read("aeo", table)
        if runs is not None:
            _put(lake, product, "clusters", name, clusters.theme_answers(found, runs.where(F.col("product") == product)))
    _put(lake, product, "clusters", "treemap", clusters.treemap(found))
    _put(lake, product, "clusters", "total", clusters.dashboard_totals(found))
    return found

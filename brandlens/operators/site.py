"""Crawl inputs and page signals: robots rules, URL selection, coverage, SEO and GEO signals, scores and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.html import parse_pages

#: URLs of each page type that a quick selection takes first.
QUICK_FIRST = (("home", 1), ("pricing", 2), ("docs", 2), ("blog", 2))
RANKS = {"high": 0, "medium": 1, "low": 2}


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where("html <> '' AND coalesce(status, 0) < 400")


def broken_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status IS NULL OR status >= 400").select("url")


def page_index(pages: DataFrame, title: Column | None = None) -> DataFrame:
    return pages.select("url", U.url_hash(F.col("url")).alias("url_hash"), (F.lit(None).cast("string") if title is None else title).alias("title"), U.page_type(F.col("url")).alias("page_type"))


def robots_rules(files: DataFrame, site: str = "site", content: str = "content") -> DataFrame:
    """(site, ord, prefix, allow) of the groups for all agents."""
    lines = files.select(site, F.posexplode(F.split(content, r"\r?\n")).alias("ord", "raw"))
    bare = lines.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where(F.instr("line", ":") > 0)
    parts = bare.select(site, "ord", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    group = F.last(F.when(F.col("key") == "user-agent", F.col("value") == "*"), ignorenulls=True)
    inside = parts.withColumn("all", group.over(W.partitionBy(site).orderBy("ord")))
    return inside.where("all AND key IN ('allow', 'disallow') AND value <> ''").select(site, "ord", F.col("value").alias("prefix"), (F.col("key") == "allow").alias("allow"))


def robots_allowed(urls: DataFrame, rules: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """urls with ``allowed``: the longest matching prefix decides, then the earlier rule; unparsable URLs are out.

    The rules of a site are one list on its row, so that every URL is judged in place, without a join by prefix.
    """
    listed = rules.groupBy(site).agg(F.collect_list(F.struct("prefix", "ord", "allow")).alias("rules"))
    path = U.url_path(F.col(url))
    fits = F.filter(F.coalesce("rules", F.array().cast("array<struct<prefix:string,ord:int,allow:boolean>>")), lambda r: F.startswith(path, r["prefix"]))
    best = F.element_at(F.sort_array(F.transform(fits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), (-r["ord"]).alias("o"), r["allow"].alias("allow"))), asc=False), 1)
    verdict = F.when(F.size(fits) == 0, F.lit(True)).otherwise(F.try_element_at(F.array(best), F.lit(1))["allow"])
    return urls.join(listed, site, "left").withColumn("allowed", path.isNotNull() & F.when(F.size(fits) == 0, F.lit(True)).otherwise(verdict)).drop("rules")


def robots_allowed_by_prefix(urls: DataFrame, rules: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """As ``robots_allowed``, for files of thousands of rules: a join on prefixes instead of a list on every row.

    Each distinct path of a site is spread into its beginnings of the lengths that the site's rules have, and these meet
    the rules by equality; the longest that is there decides. Work grows with the lengths, not with the rules. A site
    with most of the paths is dealt out by path.
    """
    known = rules.groupBy(F.col(site).alias("r_site"), "prefix").agg(F.min_by("allow", "ord").alias("allow")).withColumn("n", F.length("prefix"))
    lengths = known.groupBy(F.col("r_site").alias("l_site")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    marked = urls.withColumn("_path", U.url_path(F.col(url)))
    paths = marked.where("_path IS NOT NULL").select(F.col(site).alias("p_site"), F.col("_path").alias("path")).distinct().join(lengths, F.col("p_site") == F.col("l_site"))
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    heads = paths.select("p_site", "path", F.explode(F.transform(fits, lambda n: F.substring("path", 1, n))).alias("head"))
    met = heads.join(known, (F.col("p_site") == F.col("r_site")) & (F.col("head") == F.col("prefix")))
    verdicts = met.groupBy("p_site", "path").agg(F.max_by("allow", "n").alias("verdict"))
    joined = marked.join(verdicts, (F.col(site) == F.col("p_site")) & (F.col("_path") == F.col("path")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in urls.columns], (F.col("_path").isNotNull() & F.coalesce("verdict", F.lit(True))).alias("allowed"))


def quick_urls(entries: DataFrame, cap: int, ord: str = "ord") -> DataFrame:
    """(url, pick): entries are (ord, url, priority). A few of each type first, those of the default language before
    others, then the rest by language and priority; the first of equal URLs counts."""
    kind, local = U.page_type(F.col("url")), U.is_localized(F.col("url"))
    marked = entries.select(ord, "url", F.coalesce("priority", F.lit(0.5)).alias("priority"), kind.alias("kind"), local.alias("local"))
    place = F.row_number().over(W.partitionBy("kind").orderBy("local", ord))
    first = F.lit(None).cast("int")
    for k, (name, most) in enumerate(QUICK_FIRST):
        first = F.when((F.col("kind") == name) & (F.col("place") <= most), F.lit(k)).otherwise(first)
    staged = marked.withColumn("place", place).withColumn("stage", F.coalesce(first, F.lit(len(QUICK_FIRST))))
    rest = F.col("stage") == len(QUICK_FIRST)
    order = ["stage", "local", F.when(rest, -F.col("priority")).otherwise(F.lit(0.0)), ord]
    once = staged.withColumn("again", F.row_number().over(W.partitionBy("url").orderBy(*order))).where("again = 1")
    # The cap bounds what is sorted: each task keeps its best rows only.
    best = once.orderBy(*order).limit(cap)
    return best.select("url", F.row_number().over(W.orderBy(*order)).cast("long").alias("pick"))


def skipped_urls(entries: DataFrame, selected: DataFrame | None) -> DataFrame:
    """(url) of the entries that a quick selection left out; none where all are taken."""
    return (entries.join(selected, "url", "left_anti") if selected is not None else entries.limit(0)).select("url")


def sitemap_coverage(entries: DataFrame, pages: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One row: total_urls, fetched_urls, broken_urls, skipped_urls as numbers; the lists are tables of their own."""
    parts = {"total_urls": entries, "fetched_urls": ok_pages(pages), "broken_urls": broken_pages(pages), "skipped_urls": skipped_urls(entries, selected)}
    every = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"))
        every = rows if every is None else every.unionByName(rows)
    return every.agg(*[F.count(F.when(F.col("part") == name, 1)).alias(name) for name in parts])


def parsed(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Every page with its parsed struct flattened; the HTML is read once."""
    own = [c for c in (id, "ord", "url") if c in pages.columns]
    return parse_pages(pages, own)


def _ord(pages: DataFrame) -> list[str]:
    """The pages' order, where they have one, goes along with their signals."""
    return ["ord"] if "ord" in pages.columns else []


def heading_issues(headings: Column) -> Column:
    """Missing or repeated h1, and levels that are skipped going down."""
    level = lambda h: F.substring(h["tag"], 2, 1).cast("int")
    n = F.size(F.filter(headings, lambda h: h["tag"] == "h1"))
    at = lambda i: F.get(headings, i)
    skips = F.filter(F.sequence(F.lit(1), F.greatest(F.size(headings) - 1, F.lit(1))), lambda i: at(i).isNotNull() & (level(at(i)) > level(at(i - 1)) + 1))
    texts = F.transform(
        skips,
        lambda i: F.format_string('heading level skipped: %s -> %s ("%s")', at(i - 1)["tag"], at(i)["tag"], F.substring(at(i)["text"], 1, 40)),
    )
    count = F.array_compact(F.array(F.when(n == 0, "missing h1").when(n > 1, F.format_string("multiple h1 tags (%d)", n))))
    return F.concat(count, texts)


def seo_signals(pages: DataFrame) -> DataFrame:
    """From parsed pages."""
    h1 = F.size(F.filter("headings", lambda h: h["tag"] == "h1"))
    return pages.select(
        *_ord(pages),
        "url",
        "title",
        F.coalesce(F.length("title"), F.lit(0)).cast("long").alias("title_length"),
        "meta_description",
        F.coalesce(F.length("meta_description"), F.lit(0)).cast("long").alias("meta_description_length"),
        "headings",
        h1.cast("long").alias("h1_count"),
        heading_issues(F.col("headings")).alias("heading_order_issues"),
        "schema_types",
        F.col("internal_links").alias("internal_link_count"),
        F.col("external_links").alias("external_link_count"),
        "images_total",
        "images_missing_alt",
        T.word_count(F.col("text")).alias("word_count"),
    )


def geo_signals(pages: DataFrame) -> DataFrame:
    """From parsed pages."""
    described = F.when(F.length("meta_description") > 30, F.col("meta_description"))
    told = F.get(F.filter("paragraphs", lambda p: p.rlike(T.DEFINITION)), F.lit(0))
    n, c, p = T.numbers(F.col("text")), T.comparatives(F.col("text")), T.promotional(F.col("text"))
    structure = F.col("lists") + F.col("tables") + F.col("definition_lists")
    return pages.select(
        *_ord(pages),
        "url",
        F.coalesce(described, told).alias("definition"),
        n.alias("numbers"),
        c.alias("comparatives"),
        p.alias("promotional"),
        T.factual_density(n, c, p).alias("factual_density"),
        "has_author",
        "has_publish_date",
        "has_update_date",
        "outbound_citations",
        F.col("lists").alias("list_count"),
        F.col("tables").alias("table_count"),
        F.col("definition_lists").alias("definition_list_count"),
        F.least(F.lit(1.0), structure / 10).alias("structure_score"),
    )


def _points(condition: Column, points: float = 100.0) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def seo_page_score() -> Column:
    meta = F.when(F.col("meta_description").isNull(), 0.0).when(F.col("meta_description_length") >= 50, 100.0).otherwise(50.0)
    alt = F.when(F.col("images_total") == 0, 100.0).otherwise(T.round_half_up(100 * (1 - F.col("images_missing_alt") / F.nullif(F.col("images_total"), F.lit(0)))).cast("double"))
    return (_points(F.col("h1_count") == 1) + meta + _points(F.size("schema_types") > 0) + alt) / 4


def geo_page_score() -> Column:
    trust = _points(F.col("has_author"), 33.0) + _points(F.col("has_publish_date"), 33.0) + _points(F.col("has_update_date"), 34.0)
    return (_points(F.col("definition").isNotNull()) + F.col("factual_density") * 100 + trust + F.col("structure_score") * 100) / 4


def seo_score(signals: DataFrame, n_broken: int | Column) -> Column:
    """As an aggregate over seo signals; the broken URLs are a number, or an aggregate too."""
    return F.greatest(F.lit(0), T.round_half_up(F.coalesce(F.avg(seo_page_score()), F.lit(0.0)) - F.least(F.lit(30), F.lit(5) * n_broken)))


def geo_score() -> Column:
    return T.round_half_up(F.coalesce(F.avg(geo_page_score()), F.lit(0.0)))


def aeo_score(share_of_voice: Column, sentiment: Column) -> Column:
    return T.round_half_up(0.6 * share_of_voice * 100 + 0.4 * ((sentiment + 1) / 2 * 100))


# The sentences of the findings and actions.
def _finding(when: Column, dimension: str, text: Column, impact: str, effort: str, action: str) -> Column:
    return F.when(when, F.struct(F.lit(dimension).alias("dimension"), text.alias("finding"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), F.lit(action).alias("suggested_action")))


def _explode(rows: DataFrame, rules: list[Column]) -> DataFrame:
    return rows.select("url", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("f.*")


def seo_findings(signals: DataFrame, broken: DataFrame) -> DataFrame:
    url = F.col("url")
    say = lambda s: F.format_string(s, url)
    pages = _explode(
        signals,
        [
            _finding(F.col("h1_count") == 0, "seo", say("Missing H1 on %s"), "medium", "low", "Add a single, descriptive H1 heading to the page."),
            _finding(F.col("h1_count") > 1, "seo", F.format_string("%d H1 tags on %s", "h1_count", url), "low", "low", "Keep exactly one H1 per page; demote the rest to H2/H3."),
            _finding(F.col("meta_description").isNull(), "seo", say("Missing meta description on %s"), "medium", "low", "Add a ~150-character meta description summarizing the page."),
            _finding(
                F.col("meta_description").isNotNull() & (F.col("meta_description_length") < 50),
                "seo",
                F.format_string("Meta description too short on %s (%d chars)", url, "meta_description_length"),
                "low",
                "low",
                "Expand the meta description to ~120-160 characters.",
            ),
            _finding(F.size("schema_types") == 0, "seo", say("No schema.org markup on %s"), "low", "medium", "Add JSON-LD structured data appropriate to the page type."),
        ],
    )
    alt = signals.agg(F.sum("images_missing_alt").alias("n"), F.count("*").alias("k")).where("n > 0").select(
        F.lit("seo").alias("dimension"),
        F.format_string("%d images missing alt text across %d crawled pages", "n", "k").alias("finding"),
        F.lit("low").alias("impact"),
        F.lit("low").alias("effort"),
        F.lit("Add descriptive alt text to every content image.").alias("suggested_action"),
    )
    dead = _explode(broken, [_finding(F.lit(True), "seo", say("Broken/unreachable sitemap URL: %s"), "medium", "low", "Fix or remove the broken URL from the sitemap.")])
    return pages.unionByName(alt).unionByName(dead)


def geo_findings(signals: DataFrame) -> DataFrame:
    say = lambda s: F.format_string(s, F.col("url"))
    return _explode(
        signals,
        [
            _finding(F.col("definition").isNull(), "geo", say('No self-contained "what is this" definition on %s'), "high", "low", "Add a short, quotable definition near the top of the page."),
            _finding(F.col("factual_density") < 0.4, "geo", say("Low factual density on %s (mostly promotional language)"), "medium", "medium", "Replace vague adjectives with concrete numbers/comparisons."),
            _finding(~F.col("has_author") & ~F.col("has_publish_date"), "geo", say("No visible author or publish date on %s"), "medium", "medium", "Add a visible byline and publish/update date."),
            _finding(F.col("structure_score") < 0.2, "geo", say("Little extractable structure on %s (no lists/tables/definitions)"), "medium", "medium", "Break key content into lists, tables, or definition blocks."),
        ],
    )


def priority_order() -> list[Column]:
    """By impact, then effort, then SEO, GEO, AEO."""
    order = lambda c, ranks: F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(c)]
    effort = {"low": 0, "medium": 1, "high": 2}
    return [order("impact", RANKS), order("effort", effort), order("dimension", {"seo": 0, "geo": 1, "aeo": 2}), F.col("finding")]


def prioritised(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*priority_order())

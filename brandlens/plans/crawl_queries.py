"""Queries of crawling: sitemap indexes, robots files of many sites, what pages are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import clusters, questions, site, tagcloud
from ..operators.numbering import number
from ..sources import sitemap
from ..sources.scratch import new_folder
from . import oracles
from .catalog import THEMES
from .oracles import PATH

HOST = r"://([^/?#]+)"
PARTS = 3


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _joined(rows: DataFrame, key: str, order: str | Column, node: Column) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, node.alias("node"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["node"]), "").alias("nodes"))


def _xml(tag: str, inside: str = "nodes") -> Column:
    return F.concat(F.lit(f"<{tag}>"), inside, F.lit(f"</{tag}>")).alias("xml")


def sitemap_frontier(spark, sf):
    """The pages' URLs as sites of sitemap indexes, crawled from their roots: a root names itself and an index for each
    first path segment, which names PARTS sitemaps and one that is not there."""
    loc = lambda tag, c: F.concat(F.lit(f"<{tag}><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{tag}>"))
    host, segment = F.regexp_extract("url", HOST, 1), F.regexp_extract("url", HOST + "/([^/?#]*)", 2)
    pages = _pages(spark, sf).select("page_id", "url", host.alias("host"), segment.alias("segment"), (F.col("page_id") % PARTS).alias("part"))
    named = pages.withColumn("root", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))).withColumn("index", F.concat(F.lit("https://"), "host", F.lit("/"), "segment", F.lit(".xml")))
    named = named.withColumn("leaf", F.concat("index", F.lit("?part="), "part", F.lit("&x=1")))
    leaves = _joined(named, "leaf", "page_id", loc("url", F.col("url"))).select(F.col("leaf").alias("url"), _xml("urlset"))
    missing = named.select("index", F.concat("index", F.lit("?none")).alias("leaf")).distinct()
    indexes = _joined(named.select("index", "leaf").distinct().unionByName(missing), "index", "leaf", loc("sitemap", F.col("leaf"))).select(F.col("index").alias("url"), _xml("sitemapindex"))
    selves = named.select("root", F.col("root").alias("index")).distinct()
    roots = _joined(named.select("root", "index").distinct().unionByName(selves), "root", "index", loc("sitemap", F.col("index"))).select(F.col("root").alias("url"), _xml("sitemapindex"))
    known = leaves.unionByName(indexes).unionByName(roots)
    starts = number(roots.select("url"), "url", start=0).select(F.array(F.col("ord").cast("int")).alias("path"), "url")
    found = sitemap.crawl_index(starts, lambda urls: urls.join(known, "url").select("url", "xml"), new_folder(spark, "frontier"))
    return sitemap.index_entries(found).select("ord", "url")


def robots_many_sites(spark, sf):
    """URLs against the robots files of their top-level domains, which the pages make: hundreds of rules a file."""
    path = U.url_path(F.col("url"))
    own = F.regexp_extract(F.regexp_extract("url", HOST, 1), r"([^.:]+)(?::\d+)?$", 1)
    pages = _pages(spark, sf).select("page_id", "url", own.alias("site"), path.alias("path"))
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Disallow: "), F.substring("path", 1, 4))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Allow: "), "path")).otherwise(F.concat(F.lit("disallow:"), "path", F.lit("  # none below")))
    files = _joined(pages, "site", "page_id", F.concat(line, F.lit("\n"))).select("site", F.concat(F.lit("User-agent: *\n"), "nodes", F.lit("User-agent: other\nDisallow: /\n")).alias("content"))
    return site.robots_allowed_by_prefix(pages.select("page_id", "url", "site"), site.robots_rules(files)).select("page_id", "url", "allowed")


def _structured(spark, sf):
    """The pages with more to find: subheadings that skip a level, two first headings, none, structured data of both
    kinds, some of it broken."""
    at, kind = F.col("page_id") % 4, F.col("page_id") % 3
    sub = F.when(at == 1, F.concat(F.lit("</h1><h3>Sub &amp; "), "page_id", F.lit("</h3><h2>Two</h2><h6>A heading of more than forty characters, all told</h6>"))).when(at == 2, "</h1><h1>Again</h1>").otherwise("</h1>")
    html = F.replace("html", F.lit("</h1>"), sub)
    html = F.when(at == 3, F.replace(F.replace(html, F.lit("<h1>"), F.lit("<h2>")), F.lit("</h1>"), F.lit("</h2><h4>Deep</h4>"))).otherwise(html)
    graph = F.concat(F.lit('{"@graph": [{"@type": "Product"}, {"@type": ["Article", "T'), "page_id", F.lit('"]}, {"@type": "Product"}, {"name": "no type"}]}'))
    data = F.when(kind == 1, F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit("</script>"))).when(kind == 2, '<script type="application/ld+json">{"@type": "Lost"</script><div itemscope itemtype="https://schema.org/Offer"></div>').otherwise("")
    return _pages(spark, sf).select("page_id", "url", F.replace(html, F.lit("</article>"), F.concat(data, F.lit("</article>"))).alias("html"))


def page_structure(spark, sf):
    """Heading problems and structured-data types of each page, in the order of the page."""
    parsed = site.parsed(_structured(spark, sf))
    levels = F.array_join(F.transform("headings", lambda h: h["tag"]), " ")
    return parsed.select("page_id", levels.alias("levels"), F.array_join(site.heading_issues(F.col("headings")), " | ").alias("issues"), F.array_join("schema_types", ",").alias("types"))


def theme_clusters_of_scrapes(spark, sf):
    """Themes of the documents' terms where the pages carry scrape artifacts, which are no terms."""
    noise = F.concat(F.lit(" "), F.array_join(F.array(*[F.lit(a) for a in questions.ARTIFACTS]), " "), F.lit(" helper"))
    pages = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("all").alias("site"), F.col("doc_id").alias("page"), F.concat(F.coalesce("text", F.lit("")), noise).alias("text"))
    return clusters.cluster_terms(tagcloud.site_tagcloud(pages), clusters.taxonomy_table(spark, THEMES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (sitemap_frontier, robots_many_sites, page_structure, theme_clusters_of_scrapes)}

ORACLE = {
    "sitemap_frontier": rf"""WITH p AS (SELECT page_id, url, 'https://' || regexp_extract(url, '{HOST}', 1) AS h, regexp_extract(url, '{HOST}/([^/?#]*)', 2) AS s FROM pages),
firsts AS (SELECT url, min({{'r': h || '/sitemap.xml', 'i': h || '/' || s || '.xml', 'l': h || '/' || s || '.xml?part=' || (page_id % {PARTS}) || '&x=1', 'p': page_id}}) AS k FROM p GROUP BY url)
SELECT row_number() OVER (ORDER BY k) - 1 AS ord, url FROM firsts""",
    "robots_many_sites": rf"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_extract(url, '{HOST}', 1), '([^.:]+)(?::\d+)?$', 1) AS site, {PATH} AS path FROM pages),
rules AS (SELECT site, page_id AS n, CASE page_id % 3 WHEN 0 THEN substring(path, 1, 4) ELSE path END AS prefix, page_id % 3 = 1 AS allow FROM p),
best AS (SELECT a.page_id, arg_min(allow, {{'a': -length(prefix), 'n': n}}) AS allow FROM p a JOIN rules r ON a.site = r.site AND starts_with(a.path, prefix) GROUP BY a.page_id)
SELECT page_id, url, coalesce(allow, true) AS allowed FROM p LEFT JOIN best USING (page_id)""",
    "page_structure": """WITH p AS (SELECT page_id, page_id % 4 AS a, page_id % 3 AS k FROM pages)
SELECT page_id, CASE a WHEN 1 THEN 'h1 h3 h2 h6' WHEN 2 THEN 'h1 h1' WHEN 3 THEN 'h2 h4' ELSE 'h1' END AS levels,
 CASE a WHEN 1 THEN 'heading level skipped: h1 -> h3 ("Sub & ' || page_id || '") | heading level skipped: h2 -> h6 ("A heading of more than forty characters,")' WHEN 2 THEN 'multiple h1 tags (2)'
 WHEN 3 THEN 'missing h1 | heading level skipped: h2 -> h4 ("Deep")' ELSE '' END AS issues,
 CASE k WHEN 1 THEN 'Product,Article,T' || page_id WHEN 2 THEN 'Offer' ELSE '' END AS types FROM p""",
    "theme_clusters_of_scrapes": f"""WITH {oracles.cloud("'all'").replace("coalesce(text, '') AS text", f"coalesce(text, '') || ' {' '.join(questions.ARTIFACTS)} helper' AS text")}, taxonomy AS ({oracles._THEMES})
SELECT theme, term, score FROM cloud LEFT JOIN taxonomy USING (term) WHERE rank <= 50 AND NOT list_contains({oracles._list(questions.ARTIFACTS)}, term)""",
}

"""Sitemaps: urlset and sitemapindex documents, expanded to a bounded depth."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number
from .clients import Fetch, documents
from .scratch import new_folder

MAX_DEPTH = 3


def entries(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """(ord, loc, lastmod, changefreq, priority) from (ord, xml); rows without loc are dropped."""
    nodes = documents.select("ord", F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("at", "node"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("node", rf"(?s)<{t}>(.*?)</{t}>", 1)), F.lit(""))
    rows = nodes.select("ord", "at", F.replace(tag("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), tag("lastmod").alias("lastmod"), tag("changefreq").alias("changefreq"), F.try_to_number(tag("priority"), F.lit("9.99")).cast("double").alias("priority"))
    return rows.where("loc is not null")


def children(documents: DataFrame) -> DataFrame:
    """(path, url) of the sitemaps that index documents (path, xml) name; a path is a document's place in each of its
    parents, so that paths are in the order in which a reader meets them."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))
    named = documents.select("path", F.posexplode(found).alias("at", "url"))
    return named.select(F.concat("path", F.array("at")).alias("path"), F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


def crawl_index(roots: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(path, xml) of the documents at roots (path, url) and below them, ``depth`` levels down. fetch maps (ord, url) to
    (url, xml) of what it could read.

    Under the folder ``frontier/level=K`` has the URLs met at level K with their first path and whether they are new, and
    ``document/level=K`` what the new ones gave; each is written before the next step reads it, so a URL is fetched once
    whatever names it and however often, and a crawl that ended halfway goes on where it was, given the same folder.
    """
    spark, met = roots.sparkSession, []
    for level in range(depth + 1):
        front, docs = f"{folder}/frontier/level={level}", f"{folder}/document/level={level}"
        if not written(spark, front):
            found = roots if level == 0 else children(met[-1])
            first = found.groupBy("url").agg(F.min("path").alias("path"))
            seen = spark.read.schema(_FRONT).parquet(*[f"{folder}/frontier/level={k}" for k in range(level)]) if level else first.limit(0)
            marked = first.join(seen.select("url", F.lit(True).alias("seen")).distinct(), "url", "left")
            marked.select("path", "url", F.isnull("seen").alias("fresh")).write.mode("overwrite").parquet(front)
        mine = spark.read.schema(_FRONT).parquet(front)
        if not written(spark, docs):
            fetch(mine.where("fresh").select(F.lit(level).cast("long").alias("ord"), "url")).select("url", "xml").write.mode("overwrite").parquet(docs)
        have = spark.read.schema("url string, xml string").parquet(*[f"{folder}/document/level={k}" for k in range(level + 1)])
        met.append(mine.join(have, "url").select("path", "xml"))
    return reduce(DataFrame.unionByName, met)


_FRONT = "path array<int>, url string, fresh boolean"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def index_entries(documents: DataFrame) -> DataFrame:
    """(ord, url, priority) of the documents (path, xml) of a crawl: numbered in a reader's order, the first of equal
    URLs."""
    found = entries(documents.withColumnRenamed("path", "ord"))
    first = found.groupBy("loc").agg(F.min(F.struct("ord", "at", "priority")).alias("e"))
    return number(first.select("e.ord", "e.at", F.col("loc").alias("url"), "e.priority").withColumnRenamed("ord", "path"), "path", "at", start=0).select("ord", "url", "priority")


def site_entries(spark: SparkSession, url: str, fetch: Fetch, folder: str | None = None) -> tuple[DataFrame, str]:
    """(ord, url, priority) of a site's sitemap, and the root document's text. A root that does not answer with 200 has
    no entries. A crawl into a given folder goes on where an earlier one ended."""
    roots = spark.createDataFrame([([0], url)], "path array<int>, url string")
    found = crawl_index(roots, lambda urls: documents(urls, fetch), folder or new_folder(spark, "sitemap"))
    root = found.where(F.size("path") == 1).first()
    return index_entries(found), root["xml"] if root else ""

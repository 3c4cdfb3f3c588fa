"""tf-idf tag clouds, keyword density and keyword-in-context phrase clouds, by site."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import new_folder

SITE_TOP, PAGE_TOP, PHRASE_TERMS, PHRASES, DENSITY_TOP = 50, 10, 30, 5, 10
#: Parts of a site that are ranked apart before the best of them are.
PARTS = 64


def _by_page(pages: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows that are all of their page, and the rows of pages that have several, if there are any."""
    several = pages.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if several.isEmpty():
        return pages, None
    folder = new_folder(pages.sparkSession, "several")
    several.write.parquet(folder)
    listed = pages.sparkSession.read.schema(several.schema).parquet(folder).alias("r")
    same = reduce(and_, [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return pages.alias("p").join(listed, same, "left_anti"), pages.alias("p").join(listed, same, "left_semi")


def term_counts(pages: DataFrame, site: str = "site", page: str = "page", text: str = "text") -> DataFrame:
    """(site, page, term, tf). A page's terms are counted on its row; only pages of several rows are put together."""
    once, several = _by_page(pages.select(site, page, text), [site, page])
    spread = lambda df: df.select(site, page, F.inline(T.counted(T.tokenize(F.col(text)))))
    if several is None:
        return spread(once)
    return spread(once).unionByName(spread(several).groupBy(site, page, "term").agg(F.sum("tf").alias("tf")))


def _idf(pages: DataFrame, site: str):
    return pages.groupBy(site).agg(F.count("*").alias("n_pages"))


def site_tagcloud(pages: DataFrame, top: int = SITE_TOP, site: str = "site", page: str = "page", text: str = "text") -> DataFrame:
    """(site, rank, term, score, document_frequency, occurrences): smoothed idf times the sum of tf; ties by term."""
    terms = term_counts(pages, site, page, text).groupBy(site, "term").agg(F.count("*").alias("document_frequency"), F.sum("tf").alias("occurrences"))
    weight = F.log((F.col("n_pages") + 1) / (F.col("document_frequency") + 1)) + 1
    scored = terms.join(_idf(pages, site), site).withColumn("score", F.round(weight * F.col("occurrences"), 6))
    # The vocabulary of one site may be everything: its parts are ranked first.
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "term")).cast("long")
    best = scored.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS))).withColumn("rank", place(site, "part")).where(F.col("rank") <= top)
    return best.withColumn("rank", place(site)).where(F.col("rank") <= top).select(site, "rank", "term", "score", "document_frequency", "occurrences")


def page_tagcloud(pages: DataFrame, top: int = PAGE_TOP, site: str = "site", page: str = "page", text: str = "text") -> DataFrame:
    """(site, page, rank, term, score)."""
    counts = term_counts(pages, site, page, text)
    df = counts.groupBy(site, "term").agg(F.count("*").alias("df"))
    weight = F.log((F.col("n_pages") + 1) / (F.col("df") + 1)) + 1
    scored = counts.join(df, [site, "term"]).join(_idf(pages, site), site).withColumn("score", F.round(weight * F.col("tf"), 6))
    rank = F.row_number().over(W.partitionBy(site, page).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(site, page, "rank", "term", "score")


def keyword_density(pages: DataFrame, top: int = DENSITY_TOP, page: str = "page", text: str = "text") -> DataFrame:
    """(page, rank, term, count, density): share of a page's tokens. A page is ranked on its row, and only where it has
    several rows are they put together."""
    once, several = _by_page(pages.select(page, text), [page])
    share = F.round(F.col("count") / F.col("total"), 6).alias("density")
    item = lambda term, tf: F.struct((-tf).alias("c"), term.alias("term"))
    best = T.let(T.tokenize(F.col(text)), lambda t: F.struct(F.size(t).alias("total"), F.slice(F.sort_array(T.counted(t, item)), 1, top).alias("best")))
    rows = once.select(page, best.alias("b")).select(page, "b.total", F.posexplode("b.best").alias("at", "x"))
    out = rows.select(page, (F.col("at") + 1).cast("long").alias("rank"), "x.term", (-F.col("x.c")).alias("count"), "total").select(page, "rank", "term", "count", share)
    if several is None:
        return out
    counts = several.select(page, F.inline(T.counted(T.tokenize(F.col(text))))).groupBy(page, "term").agg(F.sum("tf").alias("count"))
    rank = F.row_number().over(W.partitionBy(page).orderBy(F.desc("count"), "term"))
    ranked = counts.withColumn("total", F.sum("count").over(W.partitionBy(page))).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.unionByName(ranked.select(page, "rank", "term", "count", share))


def phrase_cloud(pages: DataFrame, terms: DataFrame, most: int = PHRASES, site: str = "site", page: str = "page", text: str = "text") -> DataFrame:
    """(site, term, pos, page, snippet): the first sentences of a site that hold a term as a word.

    A site's terms (a top list) are one array on its pages; each sentence looks for them in place, and only what is
    found leaves its row, shortened. An ASCII term is a word where it is a whole run of ``\\w``, so that a sentence is cut
    into runs once for all of them; others are looked for one by one. The first sentences are ranked within parts of
    the pages, then among those.
    """
    ascii = F.col("term").rlike("^[a-z]+$")
    bound = F.concat(F.lit("(?i)" + T.BOUNDARY), T.quote(F.col("term")), F.lit(T.BOUNDARY))
    listed = terms.groupBy(site).agg(F.collect_set(F.when(ascii, F.col("term"))).alias("plain"), F.collect_set(F.when(~ascii, F.struct("term", bound.alias("bound")))).alias("other"))
    lines = pages.join(listed, site).select(site, page, "plain", "other", F.posexplode(T.split_sentences(F.col(text))).alias("sentence", "line"))
    # In lower case two characters turn into ASCII letters, which they are not in a sentence.
    low = F.lower(F.replace(F.replace("line", F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")))
    plain = F.array_intersect("plain", F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)))
    rare = T.let(F.lower("line"), lambda x: F.filter("other", lambda t: F.contains(x, t["term"]) & (F.regexp_instr(F.col("line"), t["bound"]) > 0)))
    found = F.concat(plain, F.when(F.size("other") > 0, F.transform(rare, lambda t: t["term"])).otherwise(F.array().cast("array<string>")))
    hits = lines.select(site, page, "sentence", T.shorten(F.col("line")).alias("snippet"), F.explode(found).alias("term"))
    hits = hits.select(site, "term", page, "sentence", "snippet", F.pmod(F.xxhash64(page), F.lit(PARTS)).alias("part"))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(page, "sentence"))
    first = hits.withColumn("pos", place(site, "term", "part")).where(F.col("pos") <= most)
    return first.withColumn("pos", place(site, "term").cast("long")).where(F.col("pos") <= most).select(site, "term", "pos", page, "snippet")

"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First rule that fits gives the type.
PAGE_TYPES = (
    ("home", r"(?i)^/?(index\.html)?$"),
    ("pricing", r"(?i)pricing|precios|planes"),
    ("blog", r"(?i)/blog(/|$)"),
    ("docs", r"(?i)/(docs|documentation|help|guide|guides)(/|$)"),
)


def url_path(url: Column) -> Column:
    """The path, ``/`` where it is empty; null where the URL does not parse."""
    path = F.try_parse_url(url, F.lit("PATH"))
    whole = F.try_parse_url(url, F.lit("HOST")).isNotNull()
    return F.when(whole, F.when(path == "", "/").otherwise(path))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def page_type(url: Column) -> Column:
    subject, out = F.coalesce(url_path(url), url), None
    for name, rule in PAGE_TYPES:
        out = F.when(subject.rlike(rule), name) if out is None else out.when(subject.rlike(rule), name)
    return out.otherwise("other")


def is_localized(url: Column) -> Column:
    """A first path segment like xx or xx-yy that does not begin with en."""
    segment = F.lower(F.regexp_extract(F.coalesce(url_path(url), F.lit("")), r"(?i)^/([a-z]{2}(?:-[a-z]{2,4})?)(?:/|$)", 1))
    return (segment != "") & ~segment.startswith("en")


def default_sitemap(site: Column) -> Column:
    return F.concat(F.regexp_replace(site, "/$", ""), F.lit("/sitemap.xml"))

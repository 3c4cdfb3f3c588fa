"""One pass over a page's HTML: everything the page signals need, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship

SCHEMA = (
    "struct<text:string,title:string,meta_description:string,headings:array<struct<tag:string,text:string>>,"
    "paragraphs:array<string>,internal_links:bigint,external_links:bigint,outbound_citations:bigint,images_total:bigint,"
    "images_missing_alt:bigint,schema_types:array<string>,lists:bigint,tables:bigint,definition_lists:bigint,"
    "has_author:boolean,has_publish_date:boolean,has_update_date:boolean>"
)
HIDDEN = {"script", "style", "nav", "header", "footer", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "footer", "nav"}, "li": {"li"}}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: list[str] = []
        self.title: list[str] | None = None
        self.titled = False
        self.meta: dict[str, str] = {}
        self.properties: dict[str, str] = {}
        self.headings: list[list] = []
        self.paragraphs: list[list[str]] = []
        self.links: list[tuple[str, bool]] = []
        self.images = self.missing = self.lists = self.tables = self.dls = 0
        self.json: list[list[str]] = []
        self.types: list[str] = []
        self.author = self.dated = self.linked = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        while self.open and tag in CLOSED_BY.get(self.open[-1], ()):
            self.open.pop()
        if tag == "meta":
            self.meta.setdefault(a.get("name", ""), a.get("content", ""))
            self.properties.setdefault(a.get("property", ""), a.get("content", ""))
        elif tag == "a" and "href" in a:
            self.links.append((a["href"], "main" in self.open or "article" in self.open))
        elif tag == "img":
            self.images += 1
            self.missing += not a.get("alt", "").strip()
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag == "table":
            self.tables += 1
        elif tag == "dl":
            self.dls += 1
        elif tag == "time" and "datetime" in a:
            self.dated = True
        elif tag == "title" and not self.titled:
            self.title, self.titled = [], True
        elif re.fullmatch("h[1-6]", tag):
            self.headings.append([tag, []])
        elif tag == "p":
            self.paragraphs.append([])
        elif tag == "script":
            self.linked = a.get("type", "").lower() == "application/ld+json"
            self.json += [[]] if self.linked else []
        if a.get("itemtype"):
            self.types.append(a["itemtype"].rstrip("/").rsplit("/", 1)[-1])
        classes = a.get("class", "")
        self.author |= a.get("rel") == "author" or "author" in classes.split() or "byline" in classes
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "script":
            if self.linked:
                self.json[-1].append(data)
            return
        if self.open and self.open[-1] == "title" and self.title is not None:
            self.title.append(data)
        if any(re.fullmatch("h[1-6]", t) for t in self.open) and self.headings:
            self.headings[-1][1].append(data)
        if "p" in self.open and self.paragraphs:
            self.paragraphs[-1].append(data)
        if not HIDDEN.intersection(self.open):
            self.text.append(data)


def _types(node, top: bool = True) -> list[str]:
    if isinstance(node, list):
        return [t for x in node for t in _types(x, top)] if top else []
    if not isinstance(node, dict):
        return []
    kind = node.get("@type")
    found = [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []
    graph = node.get("@graph")
    return found + ([t for x in graph for t in _types(x, False)] if isinstance(graph, list) else [])


def _host(url: str) -> str | None:
    try:
        parts = urlsplit(url)
        return parts.hostname or "" if parts.scheme else None
    except ValueError:
        return None


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parse_page(url: str | None, html: str | None) -> dict:
    """The struct of SCHEMA as a dict. Unclosed tags and malformed JSON-LD are tolerated."""
    page, raw = _Page(), html or ""
    page.feed(raw)
    page.close()
    own = _host(url or "")
    internal = external = cited = 0
    for href, inside in page.links:
        try:
            host = _host(urljoin(url, href)) if own else None
        except ValueError:
            host = None
        if inside and host is not None and host != own:
            cited += 1
        if href and not href.startswith(("#", "mailto:", "tel:")):
            outside = host is not None and host != own
            external, internal = external + outside, internal + (not outside)
    types = []
    for parts in page.json:
        try:
            types += _types(json.loads("".join(parts)))
        except ValueError:
            continue
    visible = _squeeze("".join(page.text))
    by = re.search(r"\bby\s+[A-Z][a-z]+\s+[A-Z][a-z]+", visible, re.ASCII)
    described = page.meta.get("description", "").strip()
    return {
        "text": visible,
        "title": _squeeze("".join(page.title)) or None if page.title is not None else None,
        "meta_description": described or None,
        "headings": [{"tag": t, "text": _squeeze("".join(x))} for t, x in page.headings],
        "paragraphs": [_squeeze("".join(p)) for p in page.paragraphs[:3]],
        "internal_links": internal,
        "external_links": external,
        "outbound_citations": cited,
        "images_total": page.images,
        "images_missing_alt": page.missing,
        "schema_types": list(dict.fromkeys([*types, *page.types])),
        "lists": page.lists,
        "tables": page.tables,
        "definition_lists": page.dls,
        "has_author": bool(page.author or page.meta.get("author", "").strip() or by),
        "has_publish_date": bool("article:published_time" in page.properties or page.dated or re.search(r'"datePublished"\s*:', raw)),
        "has_update_date": bool("article:modified_time" in page.properties or re.search(r'"dateModified"\s*:', raw)),
    }


#: Pages whose parsed texts a task holds at once.
PAGES = 64


def parse_pages(pages: DataFrame, own: list[str]) -> DataFrame:
    """The columns ``own`` of pages (url, html, ...) and the fields of SCHEMA: each page is parsed once, whatever is read
    of it, batch by batch. A null url or html is empty."""
    ship(pages.sparkSession)
    fields = T.StructType.fromDDL(SCHEMA)
    kinds = to_arrow_schema(fields)
    given = pages.select(*own, F.col("url").alias("_url"), F.col("html").alias("_html"))
    names = [*own, *fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES):
                part = batch.slice(low, PAGES)
                rows = [parse_page(u, h) for u, h in zip(part.column(len(own)).to_pylist(), part.column(len(own) + 1).to_pylist())]
                found = pa.RecordBatch.from_pylist(rows, schema=kinds)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *found.columns], names=names)

    return given.mapInArrow(run, T.StructType([*given.schema.fields[: len(own)], *fields.fields]))


def closed_references(html: Column) -> Column:
    """HTML in which only character references that a semicolon ends are references; the parser, as browsers, also takes
    ``&amp`` without one, as a text that was cut may end."""
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def parse_html(url: Column, html: Column) -> Column:
    """One Arrow-batched call a page; read its fields from a written or persisted table."""
    return F.udf(parse_page, SCHEMA, useArrow=True)(url, html)

"""Queries of a dashboard: sources of documents as products, conversations dealt out to them as runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, metrics
from ..operators.numbering import number
from ..sources.scratch import new_folder
from . import oracles
from .catalog import BRANDS, _findings, _t


def _products(spark, sf):
    """(product, pages, k, brand): sources by name; one of the brands each, by turns."""
    sized = _t(spark, sf, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("product")).agg(F.count("*").alias("pages"))
    brand = F.element_at(F.array(*[F.lit(b) for b in BRANDS]), (F.col("k") % len(BRANDS) + 1).cast("int"))
    return number(sized, "product", name="k", start=0).withColumn("brand", brand)


def _product_runs(spark, sf, products):
    """Answers by product: a conversation belongs to the product of its number, every third product has none."""
    n = products.count()
    said = _t(spark, sf, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    runs = said.select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), "text", F.when(F.col("turn") == 1, "generic").otherwise("specific").alias("specificity"), (F.col("conv_id") % n).alias("k"))
    return runs.join(products.where("k % 3 <> 2").select("product", "k"), "k").drop("k")


def _facts(spark, sf):
    """All products' facts, written; then those of every other one again, which replaces their partitions."""
    products = _products(spark, sf)
    runs, path = _product_runs(spark, sf, products), f"{new_folder(spark, 'products')}/fact"
    found = dashboard.product_facts(runs, metrics.extract_mentions(runs, BRANDS), metrics.brand_table(spark, BRANDS), products.select("product", "brand"))
    dashboard.replace_facts(found, path)
    dashboard.replace_facts(found.join(products.where("k % 2 = 0").select("product"), "product", "left_semi"), path)
    return products, dashboard.read_facts(spark, path)


def product_summary(spark, sf):
    """Every source, and what is known of its answers where there are any."""
    products, facts = _facts(spark, sf)
    out = dashboard.product_summary(products.select("product", "pages"), facts)
    return out.select("product", "pages", "reported", "brand", "runs", F.round("share_of_voice", 6).alias("share_of_voice"), "mention_count")


def dashboard_bars(spark, sf):
    """The first product's brand in the generic answers of every product, best first."""
    products, facts = _facts(spark, sf)
    mine = products.where("k = 0").first()["product"]
    out = dashboard.bars(dashboard.cross_audit(facts, mine), "product")
    return out.select("place", "product", "label", F.round("value", 6).alias("value"), "percent", "highlighted")


def top_priorities(spark, sf):
    """The findings of all pages that a dashboard shows, in order."""
    return dashboard.top_priorities(_findings(spark, sf))



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (product_summary, dashboard_bars, top_priorities)}

_PRODUCTS = f"""products AS (SELECT source AS product, count(*) AS pages, row_number() OVER (ORDER BY source) - 1 AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
owned AS (SELECT *, ({oracles._list(BRANDS)})[(k % {len(BRANDS)} + 1)::INT] AS brand FROM products),
dealt AS (SELECT product, brand, k, conv_id || '-' || turn AS run_id, turn = 1 AS generic FROM conversations JOIN owned ON conv_id % (SELECT count(*) FROM owned) = k WHERE role = 'assistant' AND text IS NOT NULL AND k % 3 <> 2),
counted AS (SELECT product, any_value(brand) AS brand, count(*) AS runs, count(*) FILTER (generic) AS picked FROM dealt GROUP BY product),
hit AS (SELECT d.product, m.brand, count(*) AS n, count(*) FILTER (generic) AS g FROM dealt d JOIN mentions m USING (run_id) GROUP BY ALL)"""
ORACLE = {
    "product_summary": f"""WITH {oracles.MENTIONS}, {_PRODUCTS}
SELECT p.product, p.pages, c.product IS NOT NULL AS reported, c.brand, c.runs, CASE WHEN c.product IS NOT NULL THEN round(coalesce(n, 0)::DOUBLE / c.runs, 6) END AS share_of_voice,
 CASE WHEN c.product IS NOT NULL THEN coalesce(n, 0) END AS mention_count FROM owned p LEFT JOIN counted c USING (product) LEFT JOIN hit h ON h.product = c.product AND h.brand = c.brand""",
    "dashboard_bars": f"""WITH {oracles.MENTIONS}, {_PRODUCTS}, mine AS (SELECT c.brand AS b FROM counted c JOIN owned USING (product) WHERE k = 0),
v AS (SELECT c.product, c.brand AS label, CASE WHEN picked > 0 THEN coalesce(g, 0)::DOUBLE / picked ELSE 0 END AS value, c.brand = b AS highlighted FROM counted c CROSS JOIN mine LEFT JOIN hit h ON h.product = c.product AND h.brand = b)
SELECT row_number() OVER (ORDER BY value DESC, product) AS place, product, label, round(value, 6) AS value, floor(value * 100 + 0.5)::BIGINT AS percent, highlighted FROM v""",
    "top_priorities": f"""WITH found AS ({oracles.ORACLE["findings_priorities"]}), rank AS (SELECT * FROM (VALUES ('high', 0), ('medium', 1), ('low', 2)) r(word, n))
SELECT f.*, row_number() OVER (ORDER BY i.n, -e.n, f.dimension = 'geo', finding) AS place FROM found f JOIN rank i ON i.word = impact JOIN rank e ON e.word = effort WHERE impact IN ('high', 'medium')""",
}

"""What a dashboard shows of many products: a table of facts, picks over it, sorted bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import number
from .site import priority_order

FACTS = "brand string, runs long, share_of_voice double, mention_count long, generic array<struct<brand:string,share_of_voice:double>>, product string"
#: What a cross-audit compares products by.
PICK = ("specificity", "generic")
SHOWN_IMPACTS = ("high", "medium")


def product_facts(runs: DataFrame, mentions: DataFrame, brands: DataFrame, owners: DataFrame, pick: tuple[str, str] = PICK) -> DataFrame:
    """One row a product that has runs: its brand's share of voice, and every brand's over the runs of the picked
    dimension value. runs (product, run_id, and the dimension), mentions (run_id, brand), owners (product, brand).

    Products share run_ids with nobody. All products are counted in two aggregations; brands are a list given in code.
    """
    dimension, value = pick
    counted = runs.groupBy("product").agg(F.count("*").alias("runs"), F.count_if(F.col(dimension) == value).alias("picked"))
    hits = runs.join(mentions.select("run_id", "brand"), "run_id").groupBy("product", "brand").agg(F.count("*").alias("n"), F.count_if(F.col(dimension) == value).alias("k"))
    own = owners.join(counted, "product").join(hits.select("product", "brand", "n"), ["product", "brand"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Every product has every brand, those without mentions too.
    listed = brands.agg(F.collect_set("brand").alias("all")).withColumn("one", F.lit(1))
    dense = counted.withColumn("one", F.lit(1)).join(listed, "one").select("product", "picked", F.explode("all").alias("brand")).join(hits, ["product", "brand"], "left")
    share = F.when(F.col("picked") > 0, F.coalesce("k", F.lit(0)) / F.col("picked")).otherwise(F.lit(0.0))
    generic = dense.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("brand", share.alias("share_of_voice")))).alias("generic"))
    return own.join(generic, "product").select("brand", "runs", (F.col("n") / F.col("runs")).alias("share_of_voice"), F.col("n").alias("mention_count"), "generic", "product")


def replace_facts(facts: DataFrame, path: str) -> None:
    """Replaces the products in facts, one partition each, and leaves the others."""
    facts.repartition("product").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("product").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(path)


def product_summary(products: DataFrame, facts: DataFrame) -> DataFrame:
    """Every product (product, ...) with its facts; those without a report have ``reported`` false and nulls."""
    return products.join(facts.withColumn("reported", F.lit(True)), "product", "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def cross_audit(facts: DataFrame, mine: str) -> DataFrame:
    """(product, label, value, highlighted): the share of voice that the brand of product ``mine`` has in each product's
    picked runs, 0 where it has none; no rows where ``mine`` has no report."""
    own = facts.where(F.col("product") == mine).select(F.col("brand").alias("my_brand"))
    found = F.filter("generic", lambda g: g["brand"] == F.col("my_brand"))
    value = F.coalesce(F.get(found, F.lit(0))["share_of_voice"], F.lit(0.0))
    # One row joins all others.
    both = facts.withColumn("one", F.lit(1)).join(own.withColumn("one", F.lit(1)), "one")
    return both.select("product", F.col("brand").alias("label"), value.alias("value"), (F.col("brand") == F.col("my_brand")).alias("highlighted"))


def bars(data: DataFrame, order: str) -> DataFrame:
    """data (label, value, ...) with ``place`` from 1 by falling value, ties by ``order``, and whole percents, halves up.
    Sorted before rounding."""
    percent = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("percent")
    return number(data, F.desc("value"), order, name="place").select("*", percent)


def top_priorities(findings: DataFrame, impacts: Sequence[str] = SHOWN_IMPACTS) -> DataFrame:
    """The findings of the impacts that a dashboard shows, with ``place`` in the order of a report."""
    return number(findings.where(F.col("impact").isin(list(impacts))), *priority_order(), name="place")

"""Brand mentions in model answers and the share-of-voice metrics over them.

Runs are (run_id, text, ...); a null text is a failed call and leaves every denominator, an empty one stays.
Brands are (brand, brand_ord), one row a brand: the audited one and its competitors, a list given in code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def brand_table(spark: SparkSession, brands: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(dict.fromkeys(brands))], "brand string, brand_ord int")


def successful(runs: DataFrame, text: str = "text") -> DataFrame:
    return runs.where(F.col(text).isNotNull())


def extract_mentions(runs: DataFrame, brands: Sequence[str], run: str = "run_id", text: str = "text") -> DataFrame:
    """(run, brand, position, role, sentiment, context): one row a brand and run, in order of first appearance.

    The brand list is a literal array, so that each text is read once and nothing is joined or shuffled.
    """
    low = F.lower(F.col(text))
    hits = F.array(*[F.struct(F.instr(low, b.lower()).alias("ix"), F.lit(i).alias("ord"), F.lit(b).alias("brand")) for i, b in enumerate(dict.fromkeys(brands)) if b])
    found = F.sort_array(F.filter(hits, lambda h: h["ix"] > 0))
    return judged(runs.select(run, text, F.posexplode(found).alias("at", "hit")), run, text)


def judged(rows: DataFrame, run: str, text: str) -> DataFrame:
    """Mentions of rows (run, text, at, hit): a brand's place in its run's order of first appearance, and where it is."""
    context = T.context_window(F.col(text), F.col("hit.ix"), F.length("hit.brand"))
    out = rows.select(run, F.col("hit.brand").alias("brand"), (F.col("at") + 1).cast("long").alias("position"), context.alias("context"))
    roles = out.withColumn("role", T.role(F.col("context"), F.col("position") == 1))
    mood = F.when(F.col("role") == "discarded", "negative").otherwise(T.sentiment(F.col("context")))
    return roles.withColumn("sentiment", mood).select(run, "brand", "position", "role", "sentiment", "context")


def _mood(sentiment: Column) -> Column:
    return F.when(sentiment == "positive", 1.0).when(sentiment == "negative", -1.0).otherwise(0.0)


def brand_metrics(mentions: DataFrame, total_runs: int | Column, brands: DataFrame, run: str = "run_id") -> DataFrame:
    """Six metrics a brand. mentions has (run, brand, position, sentiment or value), one row a run and brand."""
    total = F.lit(total_runs).cast("double") if isinstance(total_runs, int) else total_runs.cast("double")
    value = F.col("value") if "value" in mentions.columns else _mood(F.col("sentiment"))
    rate = lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0))
    stats = mentions.groupBy("brand").agg(
        F.count("*").alias("n"), F.avg("position").alias("position"), F.avg(value).alias("mood"), F.count(F.when(F.col("position") == 1, 1)).alias("first")
    )
    own = brands.join(stats, "brand", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = own.withColumn("share_of_voice", rate(F.col("n")))
    everyone = W.partitionBy()
    others = (F.sum("share_of_voice").over(everyone) - F.col("share_of_voice")) / (F.count("*").over(everyone) - 1)
    # Running sums leave a trace where all others are 0.
    others = F.when(F.sum("n").over(everyone) == F.col("n"), F.lit(0.0)).otherwise(others)
    base = F.coalesce(F.nullif(others, F.lit(0.0)), F.nullif(rate(F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return own.select(
        "brand",
        "share_of_voice",
        (F.col("share_of_voice") / base).alias("relative_share_of_voice"),
        F.col("position").alias("average_position"),
        rate(F.coalesce("first", F.lit(0))).alias("first_mention_rate"),
        F.coalesce("mood", F.lit(0.0)).alias("sentiment_score"),
        F.col("n").alias("mention_count"),
    )


def co_occurrence(mentions: DataFrame, run: str = "run_id") -> DataFrame:
    """(brand, other_brand, count) over runs that mention both: pairs are spread out of each run's own list."""
    sets = mentions.groupBy(run).agg(F.collect_set("brand").alias("all"))
    pairs = sets.select(F.explode("all").alias("brand"), "all").select("brand", F.explode("all").alias("other_brand"))
    return pairs.where("brand <> other_brand").groupBy("brand", "other_brand").agg(F.count("*").alias("count"))


def dimension_breakdown(runs: DataFrame, mentions: DataFrame, brands: DataFrame, dimensions: Sequence[str], run: str = "run_id") -> DataFrame:
    """(dimension, value, brand, share_of_voice, run_count), with every brand for every value; null values are skipped.

    Dimensions are unpivoted once; all are counted in two aggregations whatever their number.
    """
    both = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    flat = runs.select(run, F.explode(both).alias("d")).select(run, "d.*").where("value is not null")
    totals = flat.groupBy("dimension", "value").agg(F.count("*").alias("run_count"))
    hits = flat.join(mentions.select(run, "brand"), run).groupBy("dimension", "value", "brand").agg(F.count("*").alias("n"))
    # Every value gets the one list of brands, a row of an array; the list is a table of its own size, checked by Spark.
    listed = brands.agg(F.collect_set("brand").alias("brands")).withColumn("one", F.lit(1))
    dense = totals.withColumn("one", F.lit(1)).join(listed, "one").select("dimension", "value", "run_count", F.explode("brands").alias("brand"))
    return dense.join(hits, ["dimension", "value", "brand"], "left").select(
        "dimension", "value", "brand", (F.coalesce("n", F.lit(0)) / F.col("run_count")).alias("share_of_voice"), "run_count"
    )


def geo_aeo_gaps(tagcloud: DataFrame, mentions: DataFrame, brand: str, top: int = 30) -> DataFrame:
    """(term, site_score, mentioned_by_model) for the top site terms; the model's words are those near the brand."""
    words = mentions.where(F.col("brand") == brand).select(F.explode(T.tokenize(F.col("context"))).alias("term")).distinct()
    best = tagcloud.where(F.col("rank") <= top).select("term", F.col("score").alias("site_score"))
    return best.join(words.withColumn("seen", F.lit(True)), "term", "left").select("term", "site_score", F.coalesce("seen", F.lit(False)).alias("mentioned_by_model"))

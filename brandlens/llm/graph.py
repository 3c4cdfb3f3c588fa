"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stash


def _star(both: DataFrame) -> DataFrame:
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return both.join(low, "u")


def components(stash: Stash, edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) of two longs each -> (node, component): the smallest node that links lead to, for all nodes with links.

    Every round is written to the shared folder; the number of rounds grows with the logarithm of the longest
    path. A table without links gives an empty result.
    """
    now = stash.put(f"{name}-0", edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    seal = lambda links: links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = seal(now)
    for k in range(1, 100):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Repeated rows do no harm here: the round ends with distinct ones.
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        down = large.where("u <> v")
        small = _star(down).select("u", "v", "low")
        linked = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v")))
        then = stash.put(f"{name}-{k}", linked.where("u <> v").distinct())
        stash.drop(f"{name}-{k - 1}")
        seen = seal(then)
        if seen == mark:
            break
        now, mark = then, seen
    else:
        raise RuntimeError("components: no fixed point after 99 rounds")
    return then.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        then.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

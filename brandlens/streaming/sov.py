"""An extension: share of voice over a stream of runs (nothing like it is in the batch tool)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mentions(runs: DataFrame, brands: Sequence[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, brand, runs) of a stream of (run_id, ts, text): each run counts once within the watermark."""
    once = runs.where("text is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])
    # The time column goes through as it is: its watermark belongs to it.
    named = [F.when(F.contains(F.lower("text"), F.lit(b.lower())), F.lit(b)) for b in dict.fromkeys(brands) if b]
    flat = once.select("ts", F.explode(F.array_compact(F.array(*named).cast("array<string>"))).alias("brand"))
    return flat.groupBy(F.window("ts", window), "brand").agg(F.count("*").alias("runs"))

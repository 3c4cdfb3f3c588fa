"""Brand mentions in assistant answers, kept up to date as conversation files arrive.

A file stream over a folder of conversations (conv_id, turn, role, text) takes the files that its checkpoint has not
seen, finds the brands of the config in the assistant's turns, and ends when there is nothing left. Tables under the
output folder:

- ``run/batch=N``: the answers (run_id) of micro-batch N, failed ones (null text) left out;
- ``mention/batch=N``: run_id, brand, position, role, sentiment, context;
- ``metric/scope=all``: share of voice and five more numbers a brand, over everything so far.

A micro-batch replaces its own partitions, so one that is run again after a failure leaves the same rows. An answer
that is delivered again counts once: ``current`` takes it from the first batch that had it, and of rows that share
their ids within a batch a brand's earliest place. Null ids are left out; null texts are failed calls.

    python -m jobs.answer_mentions --turns DIR --out DIR --checkpoint DIR [--config jobs/answer_mentions.json]
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.operators import metrics

from .common import command_line, prepare, read_table

log = logging.getLogger("jobs.answer_mentions")

TURNS = "conv_id long, turn long, role string, text string"
RUN = "run_id string, batch long"
MENTION = "run_id string, brand string, position long, role string, sentiment string, context string, batch long"
METRIC = (
    "brand string, share_of_voice double, relative_share_of_voice double, average_position double, first_mention_rate double, "
    "sentiment_score double, mention_count long, run_count long, scope string"
)


def answers(turns: DataFrame) -> DataFrame:
    """(run_id, text) of the assistant's turns that have one."""
    said = turns.where("role = 'assistant' AND text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return said.select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), "text")


def mentions(runs: DataFrame, brands: Sequence[str]) -> DataFrame:
    """One row a run and brand. Rows that share their run_id are rare: only what is found is grouped, not the texts."""
    found = metrics.extract_mentions(runs, brands)
    first = F.min(F.struct("position", "role", "sentiment", "context")).alias("m")
    return found.groupBy("run_id", "brand").agg(first).select("run_id", "brand", "m.*")


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(runs, mentions) as they stand: each run with the batch that had it first."""
    runs = read_table(spark, f"{out}/run", RUN).groupBy("run_id").agg(F.min("batch").alias("batch"))
    return runs, read_table(spark, f"{out}/mention", MENTION).join(runs, ["run_id", "batch"]).drop("batch")


def run(spark: SparkSession, turns: str, out: str, checkpoint: str, brands: Sequence[str], files: int = 256) -> dict[str, int]:
    """Takes the new files, ``files`` of them a micro-batch, then writes the metrics anew; the counts that it logs."""
    for table, schema in (("run", RUN), ("mention", MENTION)):
        prepare(spark, f"{out}/{table}", schema, ["batch"])
    taken = {"batches": 0, "read": 0, "runs": 0, "mentions": 0}

    def take(batch: DataFrame, number: int) -> None:
        runs = answers(batch)
        for table, rows, schema in (("run", runs.select("run_id").distinct(), RUN), ("mention", mentions(runs, brands), MENTION)):
            marked = rows.withColumn("batch", F.lit(number).cast("long"))
            marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{table}")
            wrote = read_table(batch.sparkSession, f"{out}/{table}", schema).where(F.col("batch") == number).count()
            taken[f"{table}s"] += wrote
            log.info("batch %d: wrote %d rows to %s", number, wrote, f"{out}/{table}")
        taken["batches"] += 1
        taken["read"] += batch.count()

    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files).parquet(turns)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    runs, found = current(spark, out)
    total = runs.count()
    measured = metrics.brand_metrics(found, total, metrics.brand_table(spark, brands)).withColumn("run_count", F.lit(total).cast("long"))
    typed = measured.withColumn("mention_count", F.col("mention_count").cast("long")).withColumn("scope", F.lit("all"))
    typed.coalesce(1).write.mode("overwrite").partitionBy("scope").parquet(f"{out}/metric")
    log.info("read %d rows of %s in %d batches; %d runs in all, metrics of %d brands in %s", taken["read"], turns, taken["batches"], total, len(set(brands)), f"{out}/metric")
    return taken | {"all_runs": total}


def output(spark: SparkSession, out: str) -> DataFrame:
    """All mentions as they stand, each with its brand's numbers."""
    numbers = read_table(spark, f"{out}/metric", METRIC).select("brand", "mention_count", "run_count", F.round("share_of_voice", 6).alias("share_of_voice"))
    return current(spark, out)[1].join(numbers, "brand")


if __name__ == "__main__":
    command_line(run, "answer_mentions", ("turns", "out", "checkpoint"))

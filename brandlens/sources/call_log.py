"""A durable log of model calls: what has been asked once is not asked again.

The log is a table of one row a (prompt_id, rep), appended to in batches of calls. A job that ended halfway is run again
with the same log: only calls that are not in it are made. A batch whose write did not end left nothing behind, so no
more than one batch of calls is ever repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clients import Ask, call_model, with_repetitions
from .scratch import new_folder

SCHEMA = "prompt_id string, rep int, prompt_text string, temperature double, timestamp string, finish_reason string, text string, error string, batch string"
#: Calls of a batch.
CALLS = 500


class CallLog:
    """The log at a path that Spark reads and writes; other columns of prompts stay with the prompts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        """One row a (prompt_id, rep): an answer before an error, then the earliest."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        rest = [c for c in rows.columns if c not in ("prompt_id", "rep")]
        first = F.min(F.struct(F.isnull("text").alias("failed"), "timestamp", *[c for c in rest if c not in ("timestamp",)])).alias("r")
        return rows.groupBy("prompt_id", "rep").agg(first).select("prompt_id", "rep", *[F.col(f"r.{c}").alias(c) for c in rest])

    def record(self, runs: DataFrame, batch: str = "recorded") -> None:
        """Adds runs that were made elsewhere: (prompt_id, rep, text) and what else of the log's columns they have."""
        have = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        given = [F.col(c).cast(t).alias(c) if c in runs.columns else F.lit(None).cast(t).alias(c) for c, t in have.items() if c != "batch"]
        runs.select(*given, F.lit(batch).alias("batch")).write.mode("append").parquet(self.path)

    def pending(self, prompts: DataFrame, runs: int, failed_again: bool = False) -> DataFrame:
        """(prompt_id, prompt_text, rep) of the calls that are not in the log; with ``failed_again``, or that failed."""
        known = self.read().where("text IS NOT NULL") if failed_again else self.read()
        wanted = with_repetitions(prompts, runs).select("prompt_id", "prompt_text", "rep")
        return wanted.join(known.select("prompt_id", "rep"), ["prompt_id", "rep"], "left_anti")

    def ask(self, prompts: DataFrame, ask: Ask, runs: int = 3, calls: int = CALLS, tasks: int = 3, failed_again: bool = False, **pacing) -> int:
        """Makes the pending calls, ``calls`` of them a batch and ``tasks`` at a time; how many there were."""
        folder = new_folder(self.spark, "pending")
        self.pending(prompts, runs, failed_again).write.parquet(folder)
        todo = self.spark.read.schema("prompt_id string, prompt_text string, rep int").parquet(folder)
        total = todo.count()
        batches = -(-total // calls)
        for k in range(batches):
            mine = todo.where(F.pmod(F.xxhash64("prompt_id", "rep"), F.lit(batches)) == k)
            answered = call_model(mine, ask, tasks=tasks, **pacing)
            self.record(answered, folder.rsplit("-", 1)[-1] + f"-{k}")
        return total

    def runs(self, prompts: DataFrame) -> DataFrame:
        """The logged runs of prompts with the prompts' columns, as ``run_prompts`` gives them."""
        rest = [c for c in prompts.columns if c not in ("id", "text", "ord")]
        asked = prompts.select(F.col("id").alias("prompt_id"), *rest)
        found = self.read().withColumn("run_id", F.concat("prompt_id", F.lit("#"), F.col("rep").cast("string")))
        return found.join(asked, "prompt_id").select("prompt_id", "prompt_text", *rest, "run_id", "temperature", "timestamp", "finish_reason", "text", "error")

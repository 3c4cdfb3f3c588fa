"""What the jobs share: their command line and tables at a path."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def prepare(spark: SparkSession, path: str, schema: str, partitions: Sequence[str]) -> None:
    """Makes the folder of a table, so that it can be read before it has rows; rows that are there stay."""
    spark.createDataFrame([], StructType.fromDDL(schema)).write.mode("append").partitionBy(*partitions).parquet(path)


def command_line(run: Callable, name: str, paths: Sequence[str], argv: Sequence[str] | None = None) -> None:
    """Paths as arguments, all else from the config; the one place that creates and stops a session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for path in paths:
        parser.add_argument(f"--{path}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = json.loads(spark.read.text(args.config, wholetext=True).first()[0])
        print(json.dumps(run(spark, *[getattr(args, p) for p in paths], **config)))
    finally:
        spark.stop()

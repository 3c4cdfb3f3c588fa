"""Folders for intermediate and returned tables that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no earlier call gave, under ``spark.checkpoint.dir``. Only a single-process master may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="brandlens-")
    return f"{shared.rstrip('/')}/brandlens/{name}-{uuid.uuid4().hex}"

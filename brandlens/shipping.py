"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Rows of an Arrow batch where the session leaves Spark's default: texts are long, and a batch is held several times.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Once per application; workers then import the same code wherever they run."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="brandlens-code-")) / "brandlens-code.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _SENT.add(app)

"""Global numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: monotonically_increasing_id keeps the task above and the row's place in it below this bit.
_BITS = 33


def number(df: DataFrame, *order: str | Column, name: str = "ord", start: int = 1) -> DataFrame:
    """df with ``name``: the place of each row in the order, from ``start``. The order must tell all rows apart that
    differ; an empty table stays empty.

    Rows are dealt out by ranges and sorted, and written once with their task and their place in it; the sizes of the
    tasks' shares (a row a task) then give each task its offset.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "numbered")
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftrightunsigned("_place", _BITS))
    sizes = sorted(tuple(r) for r in rows.groupBy("_part").count().collect())
    ends = accumulate(n for _, n in sizes)
    offsets = spark.createDataFrame([(part, start + end - n) for (part, n), end in zip(sizes, ends)], "_part long, _before long")
    # A row a task of the sort: the number of shuffle partitions bounds it.
    placed = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _BITS) - 1)))
    return placed.select(*[F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys([*df.columns, name])])

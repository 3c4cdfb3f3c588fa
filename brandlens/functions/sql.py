"""Table functions for SQL: ``SELECT * FROM runs, LATERAL mentions(text, array('A', 'B'))``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import text as T


def _words(words: Sequence[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in dict.fromkeys(words)) + ")"


def _says(words: Sequence[str]) -> str:
    return f"exists({_words(words)}, w -> contains(lower(around), w))"


def mentions_function(name: str = "mentions") -> str:
    """The statement that makes the function: rows of ``metrics.extract_mentions`` for one text, without Python."""
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(given STRING, brands ARRAY<STRING>)
RETURNS TABLE(brand STRING, position BIGINT, role STRING, sentiment STRING, context STRING)
RETURN
  WITH hits AS (SELECT sort_array(filter(transform(array_distinct(brands), (b, i) -> named_struct('ix', instr(lower(given), lower(b)), 'ord', i, 'brand', b)),
                                         h -> h.ix > 0 AND h.brand <> '')) AS found),
  placed AS (SELECT posexplode(found) AS (at, hit) FROM hits),
  seen AS (SELECT at, hit.brand AS brand, substring(given, greatest(1, hit.ix - {T.RADIUS}), hit.ix + length(hit.brand) + {T.RADIUS} - greatest(1, hit.ix - {T.RADIUS})) AS around FROM placed),
  judged AS (SELECT *, CASE WHEN {_says(T.DISCARD)} THEN 'discarded' WHEN {_says(T.COMPARISON)} THEN 'compared' WHEN at = 0 THEN 'recommended_first' ELSE 'mentioned' END AS role,
                    {_says(T.POSITIVE)} AS good, {_says(T.NEGATIVE)} AS bad FROM seen)
  SELECT brand, CAST(at + 1 AS BIGINT), role,
         CASE WHEN role = 'discarded' THEN 'negative' WHEN good AND NOT bad THEN 'positive' WHEN bad AND NOT good THEN 'negative' ELSE 'neutral' END, around
  FROM judged"""


def register(spark: SparkSession) -> None:
    """Makes ``mentions`` known to the session's SQL."""
    spark.sql(mentions_function())

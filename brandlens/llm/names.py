"""Names for helper columns that cannot clash with a table's own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of exactly this name, whatever dots or backticks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it; Spark tells names apart without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def unused_prefix(columns: Iterable[str], prefix: str) -> str:
    """``prefix``, with underscores behind it until no column begins with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(prefix.lower()) for c in taken):
        prefix += "_"
    return prefix

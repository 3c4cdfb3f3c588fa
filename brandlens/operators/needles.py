"""All places of hundreds of names in texts: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_MACHINES: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def machine(needles: tuple[str, ...]) -> ahocorasick.Automaton:
    """One per worker process and list; each needle carries its number and length."""
    if needles not in _MACHINES:
        made = ahocorasick.Automaton()
        for k, needle in enumerate(needles):
            made.add_word(needle, (k, len(needle)))
        made.make_automaton()
        _MACHINES[needles] = made
    return _MACHINES[needles]


def positions(text: str, needles: tuple[str, ...]) -> dict[int, list[int]]:
    """Needle's number -> where it begins, from 1. Places of one needle do not overlap (the earlier one counts); places
    of different needles may."""
    found: dict[int, list[int]] = {}
    free = [0] * len(needles)
    if needles:
        for last, (k, size) in machine(needles).iter(text):
            begin = last - size + 1
            if begin >= free[k]:
                found.setdefault(k, []).append(begin + 1)
                free[k] = last + 1
    return found


def find_all(runs: DataFrame, names: Sequence[str], run: str = "run_id", text: str = "text") -> DataFrame:
    """(run, name, positions array): one row a run and name that occurs in its text, whatever the case.

    The list of names is the automaton, a few megabytes for many thousands; equal names count once, in lower case too
    (the first spelling stays), empty ones never occur. A null text has no rows. Positions are code points of the text
    in lower case.
    """
    ship(runs.sparkSession)
    spelled: dict[str, str] = {}
    for name in names:
        if name:
            spelled.setdefault(name.lower(), name)
    needles, shown = tuple(spelled), list(spelled.values())
    slim = runs.where(F.col(text).isNotNull()).select(F.col(run).alias("run"), F.lower(text).alias("low"))
    kind = slim.schema["run"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, who, where = [], [], []
            for row, low in enumerate(batch.column(1).to_pylist()):
                for k, places in positions(low, needles).items():
                    at.append(row)
                    who.append(shown[k])
                    where.append(places)
            keys = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(who, pa.string()), pa.array(where, pa.list_(pa.int32()))], names=["run", "name", "positions"])

    return slim.mapInArrow(walk, f"run {kind}, name string, positions array<int>").withColumnRenamed("run", run)


def extract_mentions_of_many(runs: DataFrame, names: Sequence[str], run: str = "run_id", text: str = "text") -> DataFrame:
    """As ``metrics.extract_mentions``, for lists too long to test one name after the other: (run, brand, position,
    role, sentiment, context). Runs with the same id must have the same text; ties in place go by the list's order."""
    from .metrics import judged

    order = F.array_position(F.array(*[F.lit(n) for n in dict.fromkeys(names)]), F.col("name"))
    hits = find_all(runs, names, run, text).select(run, F.struct(F.col("positions")[0].alias("ix"), order.alias("ord"), F.col("name").alias("brand")).alias("hit"))
    rows = hits.groupBy(run).agg(F.sort_array(F.collect_list("hit")).alias("hits")).join(runs.select(run, text).dropDuplicates([run]), run)
    return judged(rows.select(run, text, F.posexplode("hits").alias("at", "hit")), run, text)


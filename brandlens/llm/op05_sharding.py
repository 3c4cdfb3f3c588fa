"""Sharding by sampled splitters: DataFrame functions only.

Records are ordered by a key of their text's checksum and a hash of their id, so that equal texts lie together
while no key is heavy. A size-weighted sample of keys gives quantile boundaries, ranges that turn out overfull are
cut again by a denser sample of their own, and running sizes inside each range give every record its place. Records
that are equal in all of key, id, size and checksum are one row with a count until the end, so that no number of them
makes a range that cannot be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Stash

SHARDS = 16
#: The first sample cuts ranges of about RANGE_BYTES, RANGES at least; sampled keys a range. One number a range
#: reaches the driver.
RANGES = 256
RANGE_BYTES = 8 << 30
SAMPLES = 16
#: A range above so many times its even share is cut again.
OVERFULL = 1.5

_UNIT = float(1 << 52)


def size_of(text: str) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def range_key(crc: Column, key: Column) -> Column:
    """32 bits of checksum above 31 bits of an MD5 of the id: rising, not negative."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.shiftleft(F.coalesce(crc, F.lit(0).cast("long")), 31) + F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 1)


def _unit(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the record only."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)) / F.lit(_UNIT)


def _boundaries(sampled: DataFrame, group: str) -> DataFrame:
    """For each group, keys that cut its sample into ``parts`` (a column) of equal number."""
    place = W.partitionBy(group).orderBy("key")
    n = F.count("*").over(W.partitionBy(group))
    part = F.floor((F.row_number().over(place) - 1) * F.col("parts") / n)
    return sampled.withColumn("part", part).groupBy(group, "part").agg(F.min("key").alias("key")).where("part > 0").select("key")


def _beside(df: DataFrame, name: str, kind: str, value: list) -> DataFrame:
    """df with one list in every row: a number a range (times shards at most), so a broadcast row of a few megabytes
    whatever the input, and no part of the plan."""
    row = df.sparkSession.createDataFrame([(1, value)], f"_one int, {name} {kind}")
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").drop("_one")


def _ranged(df: DataFrame, splitters: list[int]) -> DataFrame:
    """df with ``range``, how many splitters are <= key: two scans of about the root of their number."""
    if not splitters:
        return df.withColumn("range", F.lit(0))
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    beside = _beside(_beside(df, "_heads", "array<long>", [b[0] for b in blocks]), "_every", "array<array<long>>", blocks)
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col("key")))
    block = F.col("_block")
    found = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + below(F.get("_every", block - 1)))
    return beside.withColumn("_block", below("_heads")).withColumn("range", found).drop("_heads", "_every", "_block")


def _stats(slim: DataFrame, splitters: list[int]) -> list:
    return _ranged(slim, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def splitters_of(slim: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES) -> list[int]:
    """Ascending range boundaries: at most ranges - 1, plus those that cut overfull ranges.

    The expected number of sampled keys is ranges * samples, whatever the input; only boundaries reach the driver.
    """
    want = ranges * samples
    drawn = slim.where(_unit(F.col("key"), 1) * total < F.col("size") * want).select("key", F.lit(0).alias("g"), F.lit(ranges).alias("parts"))
    first = sorted({r["key"] for r in _boundaries(drawn, "g").collect()})
    heavy = [(r["range"], r["bytes"], int(2 * r["bytes"] * ranges / total) + 1) for r in _stats(slim, first) if r["bytes"] > OVERFULL * total / ranges and r["n"] > 1]
    if not heavy:
        return first
    # At most a row a range.
    known = slim.sparkSession.createDataFrame(heavy, "range int, whole long, parts long")
    inside = _ranged(slim, first).join(F.broadcast(known), "range")
    again = inside.where(_unit(F.col("key"), 2) * F.col("whole") < F.col("size") * samples * F.col("parts"))
    return sorted({*first, *(r["key"] for r in _boundaries(again, "range").collect())})


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of docs, under the law ``bytes``.

    Shards are stretches of the global order with equal bytes, up to one record. Equal texts lie together and
    share a shard unless a shard's end falls among them. A null text has size 1 and no checksum; equal rows are
    interchangeable; an empty table gives an empty result; other columns are not looked at. One text longer than
    a shard's share fills its shard alone, and shards inside it stay empty.
    """
    stash = Stash(docs.sparkSession, "shard")
    crc = F.crc32(F.col(f"`{text}`")).cast("long")
    single = docs.select(F.col(f"`{key}`").alias("doc_id"), size_of(f"`{text}`").alias("each"), crc.alias("text_crc32"))
    single = single.withColumn("key", range_key(F.col("text_crc32"), F.col("doc_id")))
    alike = single.groupBy("key", "doc_id", "each", "text_crc32").agg(F.count("*").alias("times"))
    slim = stash.put("slim", alike.withColumn("size", F.col("each") * F.col("times")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    splitters = splitters_of(slim, total, max(ranges, -(-total // RANGE_BYTES))) if total else []
    stats = {r["range"]: r["bytes"] for r in _stats(slim, splitters)}
    offset, bytes_before = 0, {}
    for r in sorted(stats):
        bytes_before[r] = offset
        offset += stats[r]
    within = W.partitionBy("range").orderBy("key", "doc_id", "each", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = _ranged(slim, splitters).withColumns({"row": F.sum("times").over(within) - F.col("times"), "inside": F.sum("size").over(within) - F.col("size")})
    placed = _beside(placed, "_before", "array<long>", _dense(bytes_before)).withColumn("begin", F.get("_before", F.col("range")) + F.col("inside"))
    # Of equal records, one after the other; a record belongs where its middle byte lies.
    spread = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    place = F.expr(f"((2 * (begin + i * each) + each) * {shards}L) div {2 * max(total, 1)}L")
    spread = spread.select("doc_id", F.col("each").alias("size"), "text_crc32", "range", (F.col("row") + F.col("i")).alias("row"), F.least(place, F.lit(shards - 1)).cast("int").alias("shard"))
    placed = stash.put("placed", spread)
    pieces = sorted(placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect())
    taken: dict[int, int] = {}
    shift = {}
    for r, s, n, first in pieces:
        shift[r * shards + s] = taken.get(s, 0) - first
        taken[s] = taken.get(s, 0) + n
    slot = F.col("row") + F.get("_shift", F.col("range") * shards + F.col("shard"))
    stash.drop("slim")
    return _beside(placed, "_shift", "array<long>", _dense(shift)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _dense(values: dict[int, int]) -> list[int]:
    """The values at their keys, 0 between them."""
    return [values.get(i, 0) for i in range(max(values, default=0) + 1)]

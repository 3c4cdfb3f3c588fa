"""Document fingerprints by consistent weighted sampling.

A text is a bag of terms: its words, A-Z in lower case, each weighed by its count. Sample k of a weighted term draws
r and c from Gamma(2, 1) and b from [0, 1), all three fixed by term and k alone; with t = floor(ln(weight) / r + b) it
has the value c * exp(-r * (t - b + 1)), and the sample of a text is the pair (term, t) of the least value. Two texts
then have the same sample with a probability that is the generalised Jaccard similarity of their bags: the sum of the
smaller weights over the sum of the larger ones. A fingerprint keeps 16 bits of each of SAMPLES samples, in hex.

The draws come from two 64-bit hashes of term and k: a Gamma value is the negative logarithm of the product of two
24-bit uniform ones. Values are compared in steps of 2^-32 of their logarithm, far above what processors differ in, so
equal texts have equal fingerprints wherever they are computed.

Defined results: null texts and texts without words have the fingerprint of the empty bag (all zeros), which is like
itself and like no other; words of more than LONG bytes count as their stretches of LONG bytes, so texts without
white space are told apart too; equal rows get equal results; an empty table gives an empty result; other columns are
not looked at and may have any names. Texts are taken whole; long ones are counted in steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from . import textnum
from .storage import Stash

SAMPLES = 96
#: Bytes of a word above which it counts as several terms.
LONG = 24
#: Bytes of text whose terms are drawn together.
GROUP = 1 << 20
_TERM_BITS = 40
_ONE_TERM = np.uint64((1 << _TERM_BITS) - 1)
_MOST = (1 << (64 - _TERM_BITS)) - 1

_SEEDS = textnum.spread(SAMPLES, 1207)


def draws(term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, b, c and a 16-bit code of terms in sample k."""
    first = textnum.mix(textnum.mix(term) ^ _SEEDS[k])
    second = textnum.mix(first + np.uint64(1))
    return _gamma(first), (second >> np.uint64(48)) / 65536.0, _gamma(second), first >> np.uint64(48)


def _gamma(bits: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from the lower 48 bits."""
    one, two = bits & np.uint64(0xFFFFFF), bits >> np.uint64(24) & np.uint64(0xFFFFFF)
    return -np.log((one + 0.5) * (two + 0.5) * 2.0**-48)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (row above, term below) and the count of each, of all texts."""
    keys, counts = [], []
    for low, high, buf, offsets in textnum.segments(texts, GROUP):
        buf = textnum.LOWER[buf]
        starts, ends, rows = textnum.words(buf, offsets)
        if not len(starts):
            continue
        stretches = -((starts - ends) // LONG)
        if (stretches > 1).any():
            rows = np.repeat(rows, stretches)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
            starts, ends = np.repeat(starts, stretches) + nth * LONG, np.repeat(ends, stretches)
            ends = np.minimum(ends, starts + LONG)
        term = textnum.hash_spans(buf, starts, ends) >> np.uint64(64 - _TERM_BITS)
        key, count = np.unique((rows + low).astype(np.uint64) << np.uint64(_TERM_BITS) | term, return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(which, np.concatenate(counts)).astype(np.int64)


def signatures(texts: list[str]) -> np.ndarray:
    """The samples of each text, 16 bits each: rows of SAMPLES."""
    return weighted_signatures(*bags(pa.array(texts, pa.large_string())), len(texts))


def weighted_signatures(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Samples of n bags given as sorted keys (row above, 40-bit term below) with whole weights."""
    out = np.zeros((n, SAMPLES), np.uint16)
    if not len(keys):
        return out
    row = (keys >> np.uint64(_TERM_BITS)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    # A term of a given weight is drawn once however many texts have it.
    weighed = (keys & _ONE_TERM) << np.uint64(64 - _TERM_BITS) | np.minimum(weights, _MOST).astype(np.uint64)
    pairs, which = np.unique(weighed, return_inverse=True)
    weight = (pairs & np.uint64(_MOST)).astype(np.int64)
    log_weight = np.log(weight)
    term = pairs >> np.uint64(64 - _TERM_BITS)
    for k in range(SAMPLES):
        r, b, c, code = draws(term, k)
        t = np.floor(log_weight / r + b)
        # Logarithms of values lie between -80 and 10; of equal ones the smaller code is the sample.
        steps = ((np.log(c) - r * (t - b + 1) + 256) * 2.0**32).astype(np.uint64)
        # The code of (term, t): nothing is mixed in where t is 0, as for every weight of 1.
        code ^= textnum.mix(t.astype(np.int64).astype(np.uint64)) >> np.uint64(48)
        least = np.minimum.reduceat((steps << np.uint64(16) | code)[which], begins)
        out[row[begins], k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def written(samples: np.ndarray) -> list[str]:
    """Four hex digits a sample."""
    return [s.astype(">u2").tobytes().hex() for s in samples]


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that two fingerprints have in common, which estimates the similarity of their bags."""
    at = lambda c, k: F.substring(c, k * 4 + 1, 4)
    same = sum((F.when(at(a, k) == at(b, k), 1).otherwise(0) for k in range(1, SAMPLES)), F.when(at(a, 0) == at(b, 0), 1).otherwise(0))
    return (same / F.lit(float(SAMPLES))).cast("double")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = bags(batch.column(1))
            made = pa.array(written(weighted_signatures(keys, counts, batch.num_rows)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fingerprint"])

    return slim.mapInArrow(run, f"doc_id {kind}, fingerprint string")


DIGEST = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The text with the last third of its code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _digests(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns DIGEST of texts and those that follow them."""
    edits = [edit(t, f) for t, f in zip(texts, following)]
    n = len(texts)
    # Most texts are also the following text of another one.
    place = {t: k for k, t in enumerate(texts)}
    more = list(dict.fromkeys(f for f in following if f not in place))
    place |= {t: n + k for k, t in enumerate(more)}
    plain = signatures([*texts, *more])
    own, changed, after = plain[:n], signatures(edits), plain[[place[f] for f in following]]
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
        pa.array(written(own), pa.string()),
        pa.array(written(changed), pa.string()),
        pa.array((own == changed).mean(axis=1), pa.float64()),
        pa.array((own == after).mean(axis=1), pa.float64()),
    ]


def _runs(rows: Iterator[tuple], limit: int = 2 * GROUP) -> Iterator[list[tuple]]:
    """Rows (key, text, following) in lists of about ``limit`` characters of text."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, code points, edited text's SHA-256, both fingerprints, and how like its own fingerprint is to
    the edited text's and to the next row's. The next row has the next smaller id (null last; equal ids in the order of
    their texts' hashes, largest first); the first row follows the last.

    Rows are dealt out once, by ranges of ids, and sorted; a task sees what follows all its rows but its last. What
    follows the last row of each task is the first one of a later task: these two rows a task are written with the
    results and matched afterwards, so work beyond the sort is a row a task.
    """
    stash = Stash(docs.sparkSession, "fingerprints")
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    id_type = _arrow_type(slim)
    names = ["doc_id", *DIGEST, "part", "first_text", "last_text"]

    def emit(rows: list[tuple], part: int) -> pa.RecordBatch:
        keys, texts, following = zip(*rows)
        nothing = pa.nulls(len(rows), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), *_digests(list(texts), list(following)), pa.array([part] * len(rows), pa.int32()), nothing, nothing], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}

        def follow() -> Iterator[tuple]:
            before = None
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if before is None:
                        ends["first"] = row[1]
                    else:
                        yield *before, row[1]
                    before = row
            ends["last"] = before

        for rows in _runs(follow()):
            yield emit(rows, part)
        if ends.get("last"):
            id_, last = ends["last"]
            digest = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([id_], id_type), *digest, pa.array([part], pa.int32()), pa.array([ends["first"]], pa.string()), pa.array([last], pa.string())], names=names)

    # Spark samples sort keys on the driver to choose the ranges, so the text itself is none of them.
    dealt = slim.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    found = stash.put("found", dealt.mapInArrow(walk, f"doc_id {kind}, {_TYPES}, part int, first_text string, last_text string"))
    whole = found.where("last_text is null").select("doc_id", *DIGEST)

    # One row a task: few, whatever the size of the table, and without their texts while they are put in order.
    ends = found.where("last_text is not null")
    order = W.orderBy("part")
    parts = ends.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    heads = ends.select(F.col("part").alias("after"), F.col("first_text").alias("following"))
    joined = ends.select("part", "doc_id", "last_text").join(parts, "part").join(heads, "after").select("doc_id", "last_text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _runs(zip(*[c.to_pylist() for c in batch.columns])):
                keys, texts, following = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, id_type), *_digests(list(texts), list(following))], names=["doc_id", *DIGEST])

    return whole.unionByName(joined.mapInArrow(finish, f"doc_id {kind}, {_TYPES}"))


def _arrow_type(slim: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(slim.schema["doc_id"].dataType)

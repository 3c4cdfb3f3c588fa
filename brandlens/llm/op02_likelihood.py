"""LM scoring: the marginal likelihood of a text over all its segmentations into vocabulary pieces.

A word's lattice holds all segmentations into pieces of the vocabulary and single bytes, the first piece with the
white-space marker in front. Each piece has one log score inside a word and another as its last piece; the pieces that
begin a word and the sign that ends a text share one distribution, those that go on another. Scores start from the
vocabulary's own and are re-estimated by expectation over all segmentations of all training words, as often as they
occur; the vocabulary's scores stay in them as a prior. No score is given to whole words as such.

Texts fall into a few classes (languages, styles), each with scores of its own. A mixture over how words begin and end, fitted
on all training texts from where a bounded sample begins, picks the class of a text. A text's score is the log probability of its class
and of the text in it: a sum over all segmentations of each word, by forward recursion in log space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .lattice import BLOCK, DoubleArray, blocks, gather, lattice_of, load_vocabulary
from .storage import Stash

#: Rounds of re-estimation over all words that occur OFTEN times and a slice of the others (one in SLICE, by hash, which
#: stands for the rest), then over all words.
WARM_ROUNDS = 6
OFTEN = 8
SLICE = 16
ROUNDS = 1
#: Weight of the vocabulary's own scores, in pieces, in each class.
PRIOR = 300.0
#: 256 at most.
CLASSES = 16
#: Starts of the mixture; the likeliest end counts.
STARTS = 6
#: Rounds over all training texts, whole, that follow.
CLASS_ROUNDS = 2
#: Where those rounds begin is fitted on at most so many training texts of at most so many characters, over so many buckets of words.
SAMPLE = 4_000
MOST_CHARS = 20_000
BUCKETS = 4096
FEATURES = BUCKETS + 256
#: Bytes of text of a group whose words are looked up together, and of a step inside it.
GROUP_BYTES = 16 << 20
STEP = 2 << 20
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
LOG10 = np.log(10.0)
#: Distinct words whose lattices are walked at once: a batch's own are too few for the steps of a walk to be cheap.
WALKED = 8_000
#: What sets a word's hash in one class apart from that in another.
_KIND = textnum.spread(256, 97).view(np.int64)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % 7 == 2


class Pieces:
    """The model's alphabet: the vocabulary's text pieces, then the bytes that are none of them, then the end.

    A piece has the number of its place inside a word, and that plus ``n`` as a word's last piece.
    """

    def __init__(self, path: str):
        vocabulary = load_vocabulary(path)
        kept = [(p, s) for p, s in zip(vocabulary.pieces, vocabulary.scores) if p]
        known = {p for p, _ in kept}
        low = min(s for _, s in kept)
        kept += [(bytes([b]), low) for b in range(256) if bytes([b]) not in known]
        self.n = len(kept) + 1
        self.end = len(kept)
        self.own = np.exp(np.array([s for _, s in kept] + [low]))
        self.own = np.concatenate([self.own, self.own])
        self.own[-1] = 0.0
        first = np.array([p[:1] == b" " for p, _ in kept] + [True])
        self.first = np.concatenate([first, first])
        self.trie = DoubleArray([p for p, _ in kept])

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Log scores of each class (row) from expected counts and the vocabulary's scores as a prior."""
        out = np.empty_like(counts)
        for group in (self.first, ~self.first):
            total = counts[:, group] + PRIOR * self.own[group] / self.own[group].sum()
            with np.errstate(divide="ignore"):
                out[:, group] = np.log(total) - np.log(total.sum(axis=1, keepdims=True))
        return out


@dataclass
class Classes:
    """logs: (features, classes) log odds of a word's feature in each class; prior: log share of each class."""

    logs: np.ndarray
    prior: np.ndarray

    def sums(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """(n, classes): the words' log odds summed by row; rows ascend."""
        out = np.zeros((n, len(self.prior)))
        if len(rows):
            at, begin = np.flatnonzero(np.diff(rows, prepend=-1)), features(buf, starts, ends)
            for f in begin:
                out[rows[at]] += np.add.reduceat(self.logs[f], at, axis=0)
        return out


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the bucket of its first three bytes, and its last byte: what tells languages and styles apart."""
    head = buf[starts].astype(np.uint64)
    for k in (1, 2):
        head |= np.where(starts + k < ends, buf[np.minimum(starts + k, len(buf) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return (textnum.mix(head) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + buf[ends - 1].astype(np.int64)


def fit_classes(counts: np.ndarray, k: int = CLASSES, rounds: int = 20, starts: int = STARTS) -> Classes:
    """A mixture of feature distributions by EM; counts is (texts, features). The likeliest of several starts."""
    n = len(counts)
    k = max(1, min(k, n))
    if not n:
        return Classes(np.full((FEATURES, 1), -np.log(FEATURES)), np.zeros(1))
    share = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    mean, draw = (share**2).mean(axis=0), np.random.default_rng(1)
    best, best_fit = None, -np.inf
    for _ in range(starts):
        # Centres are drawn by how far they lie from those there are.
        centres = [int(draw.integers(n))]
        far = ((share - share[centres[0]]) ** 2).sum(axis=1)
        while len(centres) < k:
            centres.append(int(draw.choice(n, p=far / far.sum()) if far.sum() > 0 else draw.integers(n)))
            far = np.minimum(far, ((share - share[centres[-1]]) ** 2).sum(axis=1))
        odds = share[centres] ** 2 + 0.5 * mean + 0.01 / FEATURES
        odds, prior = odds / odds.sum(axis=1, keepdims=True), np.full(k, 1.0 / k)
        for _ in range(rounds):
            fit = counts @ np.log(odds).T.astype(np.float32) + np.log(prior)
            top = fit.max(axis=1, keepdims=True)
            own = np.exp(fit - top)
            whole = own.sum(axis=1, keepdims=True)
            own /= whole
            odds = own.T.astype(np.float32) @ counts + 0.05
            odds, prior = odds / odds.sum(axis=1, keepdims=True), (own.sum(axis=0) + 1.0) / (n + k)
        if (total := float((np.log(whole) + top).sum())) > best_fit:
            best, best_fit = Classes(np.log(odds).T.astype(np.float32), np.log(prior)), total
    return best


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and starts, ends, rows and hashes of the words."""
    buf = textnum.LOWER[buf]
    starts, ends, rows = textnum.words(buf, offsets)
    return buf, starts, ends, rows, textnum.hash_spans(buf, starts, ends).view(np.int64)


def _classify(classes: Classes, column: pa.Array) -> np.ndarray:
    """The class of each text: the likeliest, of equals the first. Reads whole texts."""
    total = np.tile(classes.prior, (len(column), 1))
    for low, high, buf, offsets in textnum.segments(column, STEP):
        buf = textnum.LOWER[buf]
        total[low:high] += classes.sums(buf, *textnum.words(buf, offsets), high - low)
    return total.argmax(axis=1)


def sample_classes(training: DataFrame, size: int = SAMPLE, most_chars: int = MOST_CHARS) -> Classes:
    """Fitted on about ``size`` texts of up to ``most_chars`` characters, drawn by a hash of id and text.

    Only drawn rows are sorted or leave their task; rows that repeat an id and text are drawn once.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 40))
    whole = training.where(F.length("text").between(1, most_chars)).select("text", draw.alias("draw"))
    edge = int(size / max(whole.count(), size) * (1 << 40))
    drawn = whole.where(F.col("draw") <= edge).dropDuplicates(["draw"])
    texts = [r["text"] for r in drawn.orderBy("draw").limit(2 * size).collect()]
    counts = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        buf = textnum.LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
        starts, ends, _ = textnum.words(buf, np.array([0, len(buf)]))
        counts[i] = np.bincount(np.concatenate(features(buf, starts, ends)), minlength=FEATURES)
    return fit_classes(counts)


def _soft(classes: Classes):
    k = len(classes.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, FEATURES + 1))
        for batch in batches:
            column = batch.column(0)

            def parts(column=column):
                for low, high, buf, offsets in textnum.segments(column, STEP):
                    buf = textnum.LOWER[buf]
                    starts, ends, rows = textnum.words(buf, offsets)
                    yield low, rows, features(buf, starts, ends) if len(rows) else ()

            # A batch of long texts is read twice rather than held.
            held = list(parts()) if column.nbytes <= GROUP_BYTES else None
            fit = np.tile(classes.prior, (len(column), 1))
            for low, rows, begin in held if held is not None else parts():
                if len(rows):
                    at = np.flatnonzero(np.diff(rows, prepend=-1))
                    for f in begin:
                        fit[low + rows[at]] += np.add.reduceat(classes.logs[f], at, axis=0)
            own = np.exp(fit - fit.max(axis=1, keepdims=True))
            own /= own.sum(axis=1, keepdims=True)
            total[:, FEATURES] += own.sum(axis=0)
            for low, rows, begin in held if held is not None else parts():
                for c in np.flatnonzero((own > 1e-9).any(axis=0)):
                    weight = own[:, c][low + rows] if len(rows) else np.zeros(0)
                    some = np.flatnonzero(weight > 1e-9)
                    for f in begin if len(some) else ():
                        total[c, :FEATURES] += np.bincount(f[some], weight[some], minlength=FEATURES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    return run


def refine_classes(training: DataFrame, classes: Classes, rounds: int = CLASS_ROUNDS) -> Classes:
    """EM over all training texts, whole: every odds and share comes from all of them. A number a class and feature
    returns to the driver, whatever the corpus."""
    k = len(classes.prior)
    for _ in range(rounds):
        found = training.select("text").mapInArrow(_soft(classes), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(k * (FEATURES + 1))
        total[found.column("at").to_numpy()] = found.column("n").to_numpy()
        total = total.reshape(k, -1)
        odds, share = total[:, :FEATURES] + 0.05, total[:, FEATURES] + 1.0
        classes = Classes(np.log(odds / odds.sum(axis=1, keepdims=True)).T.astype(np.float32), np.log(share / share.sum()))
    return classes


def _tag(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_classify(classes, batch.column(2)).astype(np.int32))], names=["doc_id", "held_out", "text", "kind"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hk, word, kind, n): distinct words of each class, as far as HELD rows of them go, and how often training rows hold
    them."""
    held: list[tuple] = []
    for batch in batches:
        trained, kinds = ~batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        for low, high, buf, offsets in textnum.segments(batch.column(2), STEP):
            buf, starts, ends, rows, hashes = _words(buf, offsets)
            kind = kinds[low:high][rows]
            hk, one, which = np.unique(hashes ^ _KIND[kind], return_index=True, return_inverse=True)
            n = np.bincount(which, trained[low:high][rows], minlength=len(hk)).astype(np.int64)
            text, bounds = gather(buf, starts[one], ends[one])
            word = pa.Array.from_buffers(pa.binary(), len(hk), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)])
            held.append((hk, word, kind[one], n))
            if sum(len(h[0]) for h in held) > 2 * HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD:
                    yield _counted(held.pop())
    if held:
        yield _counted(_merged(held))


def _merged(parts: list[tuple]) -> tuple:
    hk, one, which = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.bincount(which, np.concatenate([p[3] for p in parts]), minlength=len(hk)).astype(np.int64)
    return hk, pa.concat_arrays([p[1] for p in parts]).take(pa.array(one)), np.concatenate([p[2] for p in parts])[one], n


def _counted(part: tuple) -> pa.RecordBatch:
    hk, word, kind, n = part
    return pa.RecordBatch.from_arrays([pa.array(hk), word, pa.array(kind), pa.array(n)], names=["hk", "word", "kind", "n"])


def _walked(batches: Iterator[pa.RecordBatch], rows: int = WALKED, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in order, batches put together to so many rows as long as their words have at most so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.column(0).nbytes for b in [*held, batch]) > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _lattices(pieces, batch: pa.RecordBatch, n: int):
    """Runs of rows of (word, kind, ...) and the lattices of their words, each behind a marker; pieces are numbered
    by class and by whether they are a word's last."""
    kinds = batch.column(1).to_numpy().astype(np.int64)
    for low, high, buf, offsets in textnum.groups(batch.column(0), 1 << 20):
        text, bounds = gather(buf, offsets[:-1], offsets[1:], head=32)
        for a, b in blocks(bounds):
            lattice = lattice_of(pieces, text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            lattice.number(n, kinds[low + a : low + b])
            yield low + a, low + b, lattice


def _expect(shared, scores, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = scores.value.ravel()
        total = np.zeros(len(flat))
        for batch in _walked(batches):
            times = batch.column(2).to_numpy().astype(np.float64)
            for low, high, lattice in _lattices(shared.value, batch, n):
                total += lattice.expected(flat, times[low:high])
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], names=["piece", "n"])

    return run


def estimate(counts: DataFrame, ends: np.ndarray, pieces: Pieces, shared) -> np.ndarray:
    """(classes, 2 n) log scores from all training words (hk, word, kind, n), as often as they occur.

    What returns to the driver is one number a class and piece, whatever the corpus.
    """
    context = counts.sparkSession.sparkContext
    scores = pieces.scores(np.zeros((len(ends), 2 * pieces.n)))
    words = counts.where("n > 0")
    often = F.col("n") >= OFTEN
    warm = words.where(often | (F.pmod("hk", F.lit(SLICE)) == 0)).withColumn("n", F.when(often, F.col("n")).otherwise(F.col("n") * SLICE))
    for k in range(WARM_ROUNDS + ROUNDS):
        sent = context.broadcast(scores)  # classes times the vocabulary's size
        part = (warm if k < WARM_ROUNDS else words).select("word", "kind", "n").mapInArrow(_expect(shared, sent, pieces.n), "piece long, n double")
        found = part.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(scores.size)
        total[found.column("piece").to_numpy()] = found.column("n").to_numpy()
        total = total.reshape(scores.shape)
        total[:, pieces.end] = ends
        scores = pieces.scores(total)
        sent.unpersist()
    return scores


def _value(shared, scores, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = scores.value.ravel()
        for batch in _walked(batches):
            value = np.zeros(batch.num_rows)
            for low, high, lattice in _lattices(shared.value, batch, n):
                value[low:high] = lattice.marginals(flat)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(value)], names=["hk", "h", "value"])

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, hk), once for each that a task meets."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        groups, kinds = batch.column(4).to_numpy(), batch.column(3).to_numpy()
        for low, high, buf, offsets in textnum.segments(batch.column(2), STEP):
            _, _, _, rows, hashes = _words(buf, offsets)
            own, hk = groups[low:high][rows], hashes ^ _KIND[kinds[low:high][rows]]
            for g in np.unique(groups[low:high]):
                parts = seen.setdefault(int(g), [])
                parts.append(np.unique(hk[own == g]))
                # Merged when what came since is as much as what there was.
                if sum(len(p) for p in parts[1:]) > len(parts[0]):
                    parts[:] = [np.unique(np.concatenate(parts))]
    for g, parts in seen.items():
        found = np.unique(np.concatenate(parts))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g, np.int32)), pa.array(found)], names=["group", "hk"])


def _score(prior: np.ndarray, end: np.ndarray, n_all: int, v_all: int, n_ends: int):
    base_of = lambda c: np.log10((c + 1.0) / (n_all + 1.0 * (v_all + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hk, c, value = (right.column(x).to_numpy() for x in ("hk", "c", "value"))
        order = np.argsort(hk)
        hk, c, value = hk[order], c[order], value[order]
        base, out = base_of(c), []
        for batch in left.to_batches():
            of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            kinds, n = of("kind").to_numpy(), batch.num_rows
            sums = np.zeros((n, 4))
            for low, high, buf, offsets in textnum.segments(of("text"), STEP):
                _, _, _, rows, hashes = _words(buf, offsets)
                at = np.searchsorted(hk, hashes ^ _KIND[kinds[low:high][rows]])
                for i, w in enumerate((None, (c > 0)[at], base[at], value[at])):
                    sums[low:high, i] += np.bincount(rows, w, minlength=high - low)
            columns = [
                of("doc_id"),
                of("held_out"),
                pa.array(sums[:, 0].astype(np.int64) + 1),
                pa.array(sums[:, 1].astype(np.int64) + (n_ends > 0)),
                pa.array(np.full(n, n_all)),
                pa.array(sums[:, 2] + base_of(n_ends)),
                pa.array((sums[:, 3] + prior[kinds] + end[kinds]) / LOG10),
            ]
            out.append(pa.Table.from_arrays(columns, names=names))
        types = (left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for t in types], names=names)

    return run


def _of_kind(values: np.ndarray) -> Column:
    """The value of a row's class."""
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("kind") + 1)


def score(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row of docs.

    Tokens are the lower-cased (A-Z) words of a text and one end; a null text counts as empty and has the end only.
    Rows that are held out are scored and never learned from. Equal rows get equal rows and are dealt apart; an empty
    table gives an empty result; other columns are not looked at. Word counts are over all training rows; words are
    told apart by 64-bit hashes. Every distinct word of a class is segmented once a pass; rows meet their words'
    values in groups of about ``group_bytes`` of text, and a long text is read in steps cut at white space.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "likelihood")
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(key).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    training = slim.where(~F.col("held_out"))
    classes = refine_classes(training, sample_classes(training))
    kind = slim.schema["doc_id"].dataType.simpleString()
    tagged = slim.mapInArrow(_tag(classes), f"doc_id {kind}, held_out boolean, text string, kind int")
    # Written once, so that a row's group is the same whenever it is read.
    rows = stash.put("rows", tagged.withColumns({"row": F.xxhash64(F.monotonically_increasing_id()), "bytes": F.octet_length("text")}))
    ends, groups = np.zeros(len(classes.prior)), np.ones(len(classes.prior), int)
    for r in rows.groupBy("kind").agg(F.sum(F.col("bytes").cast("long") + 1).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).collect():
        ends[r["kind"]], groups[r["kind"]] = r["ends"], r["bytes"] // group_bytes + 1
    n_ends, first = int(ends.sum()), np.cumsum(groups) - groups
    counted = rows.select("held_out", "kind", "text").mapInArrow(_count, "hk long, word binary, kind int, n long")
    counts = stash.put("counts", counted.groupBy("hk", "word", "kind").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("h", F.col("hk").bitwiseXOR(_of_kind(_KIND[: len(ends)])))
    known = counts.groupBy("h").agg(F.sum("n").alias("c"))
    n_words, v_words = known.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    pieces = Pieces(vocabulary)
    shared = spark.sparkContext.broadcast(pieces.trie)  # its size is the vocabulary's
    scores = estimate(counts, ends, pieces, shared)
    sent = spark.sparkContext.broadcast(scores)
    values = counts.select("word", "kind", "hk", "h").mapInArrow(_value(shared, sent, pieces.n), "hk long, h long, value double")
    values = stash.put("values", values.join(known, "h").select("hk", "c", "value"))
    # Groups are of one class, whose texts share more words.
    group = (_of_kind(first) + F.pmod("row", _of_kind(groups))).cast("int").alias("group")
    grouped = rows.select("doc_id", "held_out", "text", "kind", group).repartition(int(groups.sum()), "group")
    needed = grouped.mapInArrow(_needed, "group int, hk long").join(values, "hk")
    return (
        grouped.groupBy("group")
        .cogroup(needed.groupBy("group"))
        .applyInArrow(
            _score(classes.prior, scores[:, pieces.end], (n_words or 0) + n_ends, (v_words or 0) + (n_ends > 0), n_ends),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )

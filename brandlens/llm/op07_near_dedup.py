"""MinHash near-dedup by a multi-index Hamming join.

A signature has CHUNKS chunks of WIDTH b-bit MinHash values. Two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) values have, by pigeonhole, a chunk with at most ERRORS = 1 error; each document therefore
enters under every chunk with each one value left out, and all such pairs meet under some key. Pairs that meet are
confirmed on their full shingle sets. Documents with equal sets are one node from the start. In a shared key, all
members are first compared with one of them; what is then not yet connected is compared with everything else under
the key, so that a group of near copies costs no quadratic work and no link between different texts is lost. In
between, groups that meet under a key try a few pairs of members, which joins most of what belongs together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum
from .graph import components
from .names import unused
from .storage import Stash

CHUNKS = 8
WIDTH = 6
ERRORS = 1
VALUES = CHUNKS * WIDTH
#: Pairs that agree in fewer values are not confirmed: at similarity 0.8 that has odds of about one in a million.
LEAST_AGREE = 24
#: Rounds in which groups that meet try a few pairs before all open pairs are compared, and pairs of two groups.
TURNS = 1
TRIES = 8
#: Open pairs of a group from which on sets are compared block by block, and nodes of a block.
BLOCK_PAIRS = 5_000
BLOCK = 256
SHINGLE = 2
PERCENT = 80

_MULTIPLY = textnum.spread(VALUES, 71) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and the bounds of each text among them.

    Texts of fewer words than a shingle has give their whole sequence as one shingle; texts without words, none.
    """
    n = len(offsets) - 1
    buf = textnum.LOWER[buf]
    starts, ends, rows = textnum.words(buf, offsets)
    word = textnum.hash_spans(buf, starts, ends)
    bounds = textnum.row_bounds(rows, n)
    count = np.diff(bounds)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    rolled = word.copy()
    for k in range(1, size):
        rolled[:-k] = textnum.mix(rolled[:-k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    # A text has count - size + 1 windows; the last words of each start none, but a short text keeps its first.
    ahead = np.repeat(bounds[1:], count) - np.arange(len(word))
    keep = ahead >= size
    short = np.flatnonzero((count > 0) & (count < size))
    for row in short:
        whole = count[row : row + 1].astype(np.uint64)
        for k in range(bounds[row], bounds[row + 1]):
            whole = textnum.mix(whole * np.uint64(0x9E3779B97F4A7C15) + word[k : k + 1])
        rolled[bounds[row]], keep[bounds[row]] = whole[0], True
    found, owner = rolled[keep], rows[keep]
    cuts = textnum.row_bounds(owner, n)
    for low, high in zip(cuts[:-1], cuts[1:]):
        found[low:high].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], textnum.row_bounds(owner[fresh], n)


def signatures(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: signature bytes (zeros where the set is empty) and two 64-bit sums that identify the set."""
    n = len(bounds) - 1
    signature, one, two = np.zeros((n, VALUES), np.uint8), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        for k in range(VALUES):
            low = np.minimum.reduceat(found * _MULTIPLY[k], at)
            signature[full, k] = (textnum.mix(low + np.uint64(k)) >> np.uint64(17)).astype(np.uint8)
        one[full] = np.add.reduceat(textnum.mix(found ^ np.uint64(0xA5A5A5A5)), at)
        two[full] = np.add.reduceat(textnum.mix(found + np.uint64(0x1234567)), at)
    return signature, one, two


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offsets in textnum.groups(batch.column(2)):
                found, bounds = shingle_sets(buf, offsets, size)
                signature, one, two = signatures(found, bounds)
                lanes = signature.reshape(high - low, VALUES // 8, 8).copy().view(np.int64)[:, :, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(np.diff(bounds)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        *[pa.array(lanes[:, k].copy()) for k in range(VALUES // 8)],
                    ],
                    names=["doc_id", "text_hash", "n", "one", "two", *SIGNS],
                )

    return run


def _meet(percent: int):
    def flat(table: pa.Table, head: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets = table.column(f"{head}set").combine_chunks()
        n = pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        return table.column(f"{head}node").to_numpy(), table.column(f"{head}group").to_numpy(), sets.flatten().to_numpy(), n

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            a, ga, xa, na = flat(left)
            b, gb, xb, nb = flat(right, "r_")
            order = np.argsort(xb, kind="stable")
            shingle, owner = xb[order], np.repeat(np.arange(len(b)), nb)[order]
            at = np.concatenate([[0], np.cumsum(na)])
            for i in range(len(a)):
                mine = xa[at[i] : at[i + 1]]
                low, high = np.searchsorted(shingle, mine, "left"), np.searchsorted(shingle, mine, "right")
                count = high - low
                hits = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[hits], minlength=len(b))
                near = np.flatnonzero((100 * both >= percent * (na[i] + nb - both)) & (gb != ga[i]))
                _, first = np.unique(gb[near], return_index=True)
                us.append(np.full(len(first), a[i]))
                vs.append(b[near[first]])
        return pa.table([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


SIGNS = [f"s{k}" for k in range(VALUES // 8)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            lanes = np.stack([part.column(1 + k).to_numpy() for k in range(VALUES // 8)], axis=1)
            chunks = lanes.view(np.uint8).reshape(part.num_rows, CHUNKS, WIDTH).astype(np.int64)
            keys = np.empty((part.num_rows, CHUNKS, WIDTH), np.int64)
            for left_out in range(WIDTH):
                key = np.arange(CHUNKS)[None, :] * WIDTH + left_out
                for k in range(WIDTH):
                    if k != left_out:
                        key = key << 8 | chunks[:, :, k]
                keys[:, :, left_out] = key
            node = np.repeat(part.column(0).to_numpy(), VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offsets in textnum.groups(batch.column(1)):
                found, bounds = shingle_sets(buf, offsets, size)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], names=["node", "set"])

    return run


def _agree() -> Column:
    """Values in which the signatures of a and b agree: zero bytes of their difference, eight at a time."""
    def equal(s: str) -> Column:
        x = F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))
        for bits in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits))
        return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    total = F.lit(0)
    for s in SIGNS:
        total = total + equal(s)
    return total


class _Join:
    def __init__(self, docs: DataFrame, percent: int, size: int):
        self.stash, self.percent, self.size, self.docs = Stash(docs.sparkSession, "near"), percent, size, docs
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.signed = self.stash.put(
            "signed",
            docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
                _sign(size), f"doc_id {kind}, text_hash long, n long, one long, two long, " + ", ".join(f"{s} long" for s in SIGNS)
            ),
        )
        # Equal sets make one node; its first document stands for it. Ids are final once written.
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
        alike = self.signed.where("n > 0").groupBy("n", "one", "two").agg(first, F.min("doc_id").alias("low"), *[F.min(s).alias(s) for s in SIGNS])
        self.nodes = self.stash.put("nodes", alike.withColumn("node", F.monotonically_increasing_id()))
        self.signs = self.nodes.select("node", "n", *SIGNS)

    def met(self) -> DataFrame:
        """(key, node, pivot) of the keys that two or more nodes share; the pivot is the least of them."""
        keys = self.nodes.select("node", *SIGNS).mapInArrow(_keys, "key long, node long")
        shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).where("pivot < high").drop("high")
        return self.stash.put("met", keys.join(shared, "key"))

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """(u, v) of the pairs whose sets are similar enough."""
        a, b = self.signs.alias("a"), self.signs.alias("b")
        near = (
            pairs.join(a, F.col("u") == F.col("a.node"))
            .join(b, F.col("v") == F.col("b.node"))
            .where((100 * F.least("a.n", "b.n") >= self.percent * F.greatest("a.n", "b.n")) & (_agree() >= LEAST_AGREE))
            .select("u", "v", F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))
        )
        near = self.stash.put(f"near-{name}", near)
        wanted = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
        sets = self.sets(wanted, name)
        both = F.size(F.array_intersect("a.set", "b.set"))
        ok = 100 * both >= self.percent * (F.col("nu") + F.col("nv") - both)
        links = near.join(sets.alias("a"), F.col("u") == F.col("a.node")).join(sets.alias("b"), F.col("v") == F.col("b.node")).where(ok)
        links = self.stash.put(f"links-{name}", links.select("u", "v"))
        self.stash.drop(f"sets-{name}", f"near-{name}")
        return links

    def labels(self) -> DataFrame:
        """(node, component) for the nodes that have links."""
        met = self.met()
        first = self.confirmed(
            met.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("v")).select(F.col("node").alias("u"), "v"), "first"
        )
        links = [first]
        for turn in range(TURNS):
            held = self.held(met, links, f"turn-{turn}", turn)
            pairs = held.where("group <> main.group").select(
                F.greatest("some", "main.some").alias("u"), F.least("some", "main.some").alias("v"), "group", F.col("main.group").alias("to")
            )
            # A few tries for each two groups; whatever they leave open is compared in full below.
            order = W.partitionBy("group", "to").orderBy(F.xxhash64("u", "v"), "u", "v")
            pairs = pairs.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRIES)
            links.append(self.confirmed(pairs.select("u", "v"), f"turn-{turn}"))
        held = self.held(met, links, "last", TURNS)
        mixed = self.placed.join(held.groupBy("key").agg(F.min("main.group").alias("main")), "key")
        # All keys of one largest group are taken together: who meets it, and who is in it.
        seats = self.stash.put("seats", mixed.select("main", "node", "group", (F.col("group") != F.col("main")).alias("asks")).distinct())
        load = seats.groupBy("main").agg(F.count(F.when(F.col("asks"), 1)).alias("asking"), F.count("*").alias("all"))
        heavy = self.stash.put("heavy", load.where(F.col("asking") * F.col("all") > BLOCK_PAIRS))
        light = mixed.join(heavy.select("main"), "main", "left_anti")
        few = light.where("group <> main").select("key", F.col("node").alias("u"), F.col("group").alias("gu"))
        every = light.select("key", F.col("node").alias("v"), F.col("group").alias("gv"), "main")
        cross = few.join(every, "key").where("gu <> gv AND (gv = main OR u > v)")
        pairs = cross.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        second = self.confirmed(pairs, "second")
        third = self.blocks(seats.join(heavy, "main"))
        return components(self.stash, reduce(DataFrame.union, [*links, second, third]))

    def blocks(self, seats: DataFrame) -> DataFrame:
        """(u, v) links between the askers of a large group and all its seats, block against block.

        Seats are dealt into blocks of about BLOCK; every asking block meets every block once, and one link a node
        and group comes out, which is all that components need. Nothing holds more than two blocks of sets.
        """
        mine = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n)).cast("int")
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
        seats = seats.withColumn("na", blocks("asking")).withColumn("nb", blocks("all"))
        sets = self.sets(seats.select("node").distinct(), "blocks")
        full = seats.join(sets, "node")
        left = full.where("asks").select("main", mine("na").alias("pa"), others("nb").alias("pb"), "node", "group", "set")
        # Other names on the right: both sides come from one table.
        again = [F.col(c).alias(f"r_{c}") for c in ("main", "node", "group", "set")]
        right = full.select(*again, others("na").alias("r_pa"), mine("nb").alias("r_pb"))
        links = left.groupBy("main", "pa", "pb").cogroup(right.groupBy("r_main", "r_pa", "r_pb")).applyInArrow(_meet(self.percent), "u long, v long")
        links = self.stash.put("links-blocks", links)
        self.stash.drop("sets-blocks")
        return links

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """(node, set) of the wanted nodes, from the text of the document that stands for each."""
        who = wanted.join(self.nodes.select("node", F.col("first.doc_id").alias("w_id"), F.col("first.text_hash").alias("w_hash")), "node")
        texts = self.docs.select("doc_id", "text").join(
            who, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_hash"))
        )
        sets = texts.select("node", "text").mapInArrow(_sets(self.size), "node long, set array<long>")
        return self.stash.put(f"sets-{name}", sets.dropDuplicates(["node"]))

    def held(self, met: DataFrame, links: list[DataFrame], name: str, turn: int) -> DataFrame:
        """(key, group, k, some, main) for the keys under which two or more groups meet: the members k of each group
        there, one of them, and the same of the largest group."""
        found = components(self.stash, reduce(DataFrame.union, links), name)
        self.placed = self.stash.put(f"placed-{name}", met.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group")))
        some = F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("some")
        held = self.placed.groupBy("key", "group").agg(F.count("*").alias("k"), some)
        main = held.groupBy("key").agg(F.max(F.struct("k", "group", "some")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return self.stash.put(f"held-{name}", held.join(main.drop("parts"), "key"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs.

    A text is lower-cased (A-Z) and cut into words; its set holds its distinct shingles. Rows link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable, itself included. Null,
    empty and wordless texts link with nothing. Rows with equal sets are linked whatever their number. A null id is
    never smallest; where a component has no other, component_id is null. An empty table gives an empty result;
    columns other than the two are not looked at.
    """
    job = _Join(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), percent, size)
    labels = job.labels()
    whole = job.nodes.join(labels, "node", "left").select("n", "one", "two", "low", F.coalesce("component", "node").alias("component"))
    least = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    known = job.stash.put("known", whole.join(least, "component").select("n", "one", "two", "component_id"))
    out = job.signed.join(known, ["n", "one", "two"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each group, with the columns of docs: that with the least id. Rows that repeat an id and text
    are one document.

    Null, empty and wordless texts link with nothing and stay. A null id is never least: a group without another keeps
    the documents of null id. An empty table gives an empty result; columns may have any names.
    """
    k_id, k_hash, own = (unused(docs.columns, n) for n in ("_k_id", "_k_hash", "_own_hash"))
    kept = near_duplicates(docs, percent=percent, size=size).where("kept").select(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash)).distinct()
    marked = docs.withColumn(own, F.xxhash64("text"))
    out = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(own) == F.col(k_hash)), "left_semi")
    return out.dropDuplicates(["doc_id", own]).drop(own)

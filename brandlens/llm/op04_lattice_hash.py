"""Embedding near-dedup by lattice hashing.

Each table projects the vectors onto eight random orthonormal directions and decodes the result to the nearest
point of the E8 lattice: a cell. A vector enters under its own cell in every table and asks for the neighbouring
cells nearest to it as well. Vectors that meet are verified by their cosine in double precision, in blocks; a pair
that meets in several cells is one link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .graph import components
from .storage import Stash

COSINE = 0.98
TABLES = 8
PROBES = 6
#: Length of a projected unit vector in lattice units: the cells' size.
SCALE = 5.0
SEED = 20240
#: Members of one cell that meet in one task; larger cells are cut into so many and every two parts meet.
PART = 512


def projections(dimension: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(tables, dimension, 8) with orthonormal columns (as far as the dimension allows)."""
    draw = np.random.default_rng(seed)
    out = np.zeros((tables, dimension, 8))
    for t in range(tables):
        q, _ = np.linalg.qr(draw.standard_normal((dimension, min(8, dimension))))
        out[t, :, : q.shape[1]] = q
    return out * SCALE * np.sqrt(max(dimension, 8) / 8.0) / 2.0


def roots() -> np.ndarray:
    """The 240 shortest lattice vectors, doubled so that they are integers."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [v for v in product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, np.int64)


_ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: rounded, with the worst coordinate rounded the other way where the sum is odd."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, doubled: the better of the nearest in D8 and in D8 shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(np.where(nearer[:, None], a, b) * 2).astype(np.int64)


_CELL = textnum.spread(9, 3) | np.uint64(1)


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], (table * 0x9E3779B97F4A7C15) % 2**64, np.uint64)
    for k in range(8):
        h = textnum.mix(h + points[..., k].astype(np.uint64) * _CELL[k])
    return h.view(np.int64)


def cells(vectors: np.ndarray, maps: np.ndarray, probes: int) -> np.ndarray:
    """(n, tables, 1 + probes): key of the own cell, then of the neighbouring cells nearest to each vector."""
    out = np.empty((len(vectors), len(maps), 1 + probes), np.int64)
    for t, m in enumerate(maps):
        x = vectors @ m
        own = decode(x)
        out[:, t, 0] = cell_keys(own, t)
        # The nearest neighbours of a cell lie along the roots that point most to where the vector is in it.
        lean = (x - own / 2.0) @ (_ROOTS / 2.0).T
        order = np.argsort(-lean, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = cell_keys(own[:, None, :] + _ROOTS[order], t)
    return out


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the vectors of each dimension, and the vectors at length 1 in double precision."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(bounds)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        x = flat[bounds[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1)[:, None]
        yield rows, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _index(tables: int, probes: int):
    """(cell, own, node): each vector under its own and its probed cells in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                for rows, x in unit_rows(batch.column(1)):
                    found = cells(x, projections(x.shape[1], tables), probes)
                    own = np.tile(np.arange(1 + probes) == 0, len(rows) * tables)
                    spot = pa.array(np.repeat(rows, tables * (1 + probes)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel()), pa.array(own), batch.column(0).take(spot), batch.column(2).take(spot)],
                        names=["cell", "own", "node", "label"],
                    )

    return run


def _close(node: np.ndarray, asks: np.ndarray, x: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an asker and a member of equal group number whose dot product reaches least; members come first."""
    begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    size = np.diff(np.append(begin, len(group)))
    members = np.add.reduceat((~asks).astype(np.int64), begin)
    us, vs = [], []
    pairs = members * (size - members)
    order = np.flatnonzero(pairs)
    at = 0
    while at < len(order):
        # Small groups are spread out together, a large one is a matrix product.
        upto = max(at + 1, int(np.searchsorted(np.cumsum(pairs[order[at:]]), 20_000)) + at)
        g = order[at:upto]
        if len(g) == 1:
            m, e = begin[g[0]] + members[g[0]], begin[g[0]] + size[g[0]]
            i, j = np.nonzero(x[m:e] @ x[begin[g[0]] : m].T >= least - 1e-9)
            i, j = i + m, j + begin[g[0]]
        else:
            many = pairs[g]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            width = np.repeat(members[g], many)
            j = np.repeat(begin[g], many) + inside % width
            i = np.repeat(begin[g] + members[g], many) + inside // width
        # Taken row by row, so that a value does not depend on the block it is found in.
        good = ((x[i] * x[j]).sum(axis=1) >= least) & (node[i] != node[j])
        us.append(node[i[good]])
        vs.append(node[j[good]])
        at = upto
    none = np.zeros(0, np.int64)
    u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
    return np.maximum(u, v), np.minimum(u, v)


def _verify(least: float):
    """Links from rows sorted by (label, cell, parts, asks); what a batch leaves open goes on with the next."""

    def links(table: pa.Table) -> pa.RecordBatch:
        node, asks = table.column("node").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        keys = np.stack([table.column(c).to_numpy() for c in ("label", "cell", "pm", "pa")])
        change = np.ones(len(node), bool)
        change[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        group = np.cumsum(change)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        column = table.column("embedding").combine_chunks()
        for rows, x in unit_rows(column):
            a, b = _close(node[rows], asks[rows], x, group[rows], least)
            u.append(a)
            v.append(b)
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in (0, 1, 2, 3)]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _label(vectors: DataFrame, name: str) -> Column:
    """A number for each label: whole numbers stand for themselves, others are hashed."""
    column, kind = F.col(f"`{name}`"), vectors.select(F.col(f"`{name}`")).schema[0].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return column.cast("long")
    # Adding zero makes the two zeros one.
    return F.when(column.isNotNull(), F.xxhash64(column + F.lit(0.0) if kind in ("float", "double") else column))


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Rows are compared when their labels, of any type, are equal and not null (told apart by 64-bit hashes); those with a cosine of at least ``least`` that the
    tables find are linked, none below it. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Equal vectors under a label are one node with a count, so copies cost nothing. Vectors of
    different dimension do not meet. A cosine of exactly ``least`` links. A null id is never smallest; rows that repeat
    an id are vectors like others. An empty table gives an empty result; other columns are not looked at.
    """
    stash = Stash(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), _label(vectors, label).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & sound & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    same = rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = stash.put("nodes", same.withColumn("node", F.monotonically_increasing_id()))
    kind = nodes.schema["embedding"].dataType.simpleString()
    entries = stash.put("entries", nodes.select("node", "embedding", "label").mapInArrow(_index(tables, probes), "cell long, own boolean, node long, label long"))
    # Only cells in which two meet matter; large ones are cut into parts that meet pair by pair.
    filled = entries.groupBy("label", "cell").agg(F.count(F.when(F.col("own"), 1)).alias("m"), F.count("*").alias("a")).where("m > 0 AND a > 1")
    parts = lambda c: F.ceil(F.col(c) / F.lit(PART)).cast("int")
    busy = filled.select("label", "cell", parts("m").alias("ms"), parts("a").alias("as"))
    met = entries.join(busy, ["label", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    askers = met.select("label", "cell", mine("as").alias("pa"), others("ms").alias("pm"), F.lit(True).alias("asks"), "node")
    members = met.where("own").select("label", "cell", mine("ms").alias("pm"), others("as").alias("pa"), F.lit(False).alias("asks"), "node")
    both = askers.unionByName(members).join(nodes.select("node", "embedding"), "node").select("label", "cell", "pm", "pa", "asks", "node", F.col("embedding").cast(kind))
    group = ["label", "cell", "pm", "pa"]
    links = both.repartition(*group).sortWithinPartitions(*group, "asks").mapInArrow(_verify(least), "u long, v long")
    links = stash.put("links", links.distinct())
    sizes = nodes.select("node", "copies")
    ends = links.select(F.col("u").alias("at"), F.col("v").alias("node")).union(links.select(F.col("v").alias("at"), F.col("u").alias("node")))
    degree = ends.join(sizes, "node").groupBy("at").agg(F.sum("copies").alias("others"))
    grouped = nodes.join(components(stash, links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    known = stash.put(
        "known",
        grouped.join(least_id, "component")
        .join(degree, F.col("node") == F.col("at"), "left")
        .select("label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")),
    )
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

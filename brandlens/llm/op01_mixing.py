"""Mixing sources to target weights by Pareto order sampling.

A source's target is filled with whole copies first (certain), then by a Pareto sample: every document has a
probability of inclusion that grows with the square root of its size, such that the expected words are the rest of the
target; those whose probability would reach 1 are certain. Documents are ranked by their random odds over their
inclusion odds and taken in that order. The sample's size is fixed by the words that are wanted: it takes documents as
long as they fit, which ends close to the sum of the probabilities. What the first document that does not fit leaves open
is filled by those after it that are no larger than the gap, in their order, or by that document itself, whichever comes
nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .names import column
from .storage import Stash

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words of the input.
TOTAL = 1.5
#: A target stops at so many times its source's size.
MOST = 2
#: Rank buckets of a source; only the bucket in which the sample ends is ranked row by row.
BUCKETS = 4096


def n_words(text: str = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size -> + target: weighted shares of the total, water-filled below most * source_size.

    Sorted by the level at which each source is full, the full ones are a prefix; running sums over that order
    give each prefix's common level, and the first prefix whose level stays below the next source's is the answer.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weighted = sizes.withColumn("pos", (F.row_number().over(order) - 1) % len(weights)).select(
        "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("pos") + 1).cast("long").alias("w")
    )
    everything, level = W.partitionBy(), F.col("source_size") * most / F.col("w")
    full = W.orderBy("full_at", F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(W.unboundedPreceding, -1)
    ranked = weighted.withColumn("full_at", level).select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0))).alias("w_left"),
        F.coalesce(F.sum("source_size").over(full), F.lit(0)).alias("size_before"),
    )
    share = (F.col("all_size") * F.lit(total) - F.col("size_before") * most) / F.col("w_left")
    # Shares rise up to the answer and fall after it, while levels rise: the answer is the largest share in reach.
    levelled = ranked.withColumn("share", share).withColumn(
        "common", F.max(F.when(F.col("share") <= F.col("full_at"), F.col("share"))).over(everything)
    )
    return levelled.select(
        "source",
        "source_size",
        F.least(F.col("source_size") * F.lit(float(most)), F.col("w") * F.coalesce("common", F.lit(float("inf")))).alias("target"),
    )


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from a document's id and text, the same wherever and whenever it is computed."""
    either = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(either), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def weight(size: Column) -> Column:
    """What inclusion probabilities are in proportion to: the root of the size, in thousandths."""
    return F.floor(F.sqrt(size.cast("double")) * 1000).cast("long")


def factors(sized: DataFrame, plan: DataFrame, same: Column) -> DataFrame:
    """(f_source, factor): min(1, factor * weight) are the probabilities whose expected words are a source's rest.

    Over sizes from the largest down, the larger ones being certain gives a factor; the first size at which it leaves
    the probability below 1 has the right one. Sums are over distinct sizes, counted before the shuffle.
    """
    down = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    on = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(0, W.unboundedFollowing)
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    seen = sizes.withColumn("larger", F.coalesce(F.sum(F.col("n") * F.col("size")).over(down), F.lit(0))).withColumn("open", F.sum(F.col("n") * F.col("size") * weight(F.col("size"))).over(on))
    tried = seen.join(plan.select("s_source", "rest"), same).withColumn("factor", (F.col("rest") - F.col("larger")) / F.col("open"))
    fits = tried.where((F.col("rest") > 0) & (F.col("factor") * weight(F.col("size")) < 1))
    return fits.groupBy(F.col("source").alias("f_source")).agg(F.max_by("factor", "size").alias("factor"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    total: float = TOTAL,
    most: int = MOST,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    buckets: int = BUCKETS,
) -> DataFrame:
    """key, size, source_size, target, copies, taken and source for every row of docs.

    Null text has size 0; a null source is a source of its own, the last; a null key is a key like another. Rows that
    share key and text rank alike, and as many of them are taken as fit. A document without words is never sampled,
    only copied whole. An empty table gives an empty result. Other columns are not looked at. One source may hold any
    share of the rows: sums are made before the shuffle, and only the bucket of ranks in which a source's sample ends
    is sorted row by row.
    """
    stash = Stash(docs.sparkSession, "mix")
    k, t, s = (F.col(f"`{c}`") for c in (key, text, source))
    sized = stash.put("sized", docs.select(k.alias("doc_id"), s.alias("source"), n_words(f"`{text}`").alias("size"), uniform(k, t).alias("u"), F.monotonically_increasing_id().alias("row")))
    cuts = _Cuts(stash, sized, weights, total, most, buckets)
    copies = F.col("copies")
    return cuts.taken(sized).select("doc_id", "size", "source_size", "target", "copies", (copies * F.col("size")).alias("taken"), "source")


class _Cuts:
    """Where the sample of each source ends: tables of one row a source, found from (doc_id, source, size, u, row)."""

    def __init__(self, stash: Stash, sized: DataFrame, weights: Sequence[int], total: float, most: int, buckets: int):
        self.buckets, self.stash = buckets, stash
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        rest = F.col("target") - F.col("whole") * F.col("source_size")
        plan = stash.put("targets", targets(sizes, weights, total, most).withColumn("whole", whole).withColumn("rest", rest)).withColumnRenamed("source", "s_source")
        self.plan = stash.put("plan", plan.join(factors(sized, plan, self._of("s_source")), F.col("s_source").eqNullSafe(F.col("f_source")), "left").drop("f_source"))
        ranked = self.ranked(sized).where("bucket IS NOT NULL")
        # The first document that does not fit, of each source that has one, and the gap before it.
        over = self._first_over(ranked.withColumn("limit", F.col("rest")), "edges", F.col("so_far") + F.col("size") > F.col("limit"))
        self.over = stash.put("over", over.select(F.col("source").alias("c_source"), F.col("at").alias("cut"), F.col("bucket").alias("edge"), (F.col("limit") - F.col("so_far")).alias("gap"), F.col("size").alias("over_size")))
        later = self._later(ranked)
        # Of those that are no larger than the gap, the first that would bring the words further off than none.
        stop = self._first_over(later.withColumn("limit", F.col("gap")), "later-edges", F.col("so_far") + F.col("size") / 2.0 > F.col("limit"), 1.5)
        stop = stash.put("stop", stop.select(F.col("source").alias("t_source"), F.col("at").alias("stop"), F.col("bucket").alias("stop_edge"), F.col("so_far").alias("filled")))
        every = later.groupBy(F.col("source").alias("l_source")).agg(F.sum("size").alias("all_later"))
        known = self.over.join(stop, F.col("c_source").eqNullSafe(F.col("t_source")), "left").join(every, F.col("c_source").eqNullSafe(F.col("l_source")), "left")
        filled = F.coalesce("filled", "all_later", F.lit(0))
        itself = F.col("over_size") / 2.0 <= F.col("gap")
        nearer = F.abs(F.col("gap") - filled) < F.when(itself, F.col("over_size") - F.col("gap")).otherwise(F.col("gap"))
        self.cut = stash.put("cuts", known.select("c_source", "cut", "edge", "gap", "stop", "stop_edge", nearer.alias("fill"), itself.alias("itself")))

    def _later(self, ranked: DataFrame) -> DataFrame:
        """The ranked rows behind their source's first that does not fit, no larger than the gap."""
        behind = (F.col("bucket") > F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (self._at() > F.col("cut")))
        return ranked.join(self.over, self._of("c_source")).where(behind & (F.col("size") <= F.col("gap")))

    @staticmethod
    def _at() -> Column:
        return F.struct("rank", "doc_id", "size", "row")

    def _first_over(self, rows: DataFrame, name: str, when: Column, reach: float = 1.0) -> DataFrame:
        """(source, bucket, at, size, so_far, limit) of each source's first row, in order of rank, for which ``when`` holds;
        so_far is the sum of sizes before it. As that sum is at most ``reach`` limits there, and with the row's size above
        the limit, only buckets in which it comes so near are looked at row by row."""
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        filled = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("size").alias("largest"), F.first("limit").alias("limit"))
        filled = filled.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        near = filled.where((F.col("before") <= F.lit(reach) * F.col("limit")) & (F.col("before") + F.col("words") + F.col("largest") > F.col("limit")))
        edge = self.stash.put(name, near.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "before"))
        inside = rows.join(edge, self._of("e_source") & (F.col("bucket") == F.col("e_bucket")))
        upto = W.partitionBy("e_source", "bucket").orderBy("rank", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
        placed = inside.withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        first = placed.where(when).groupBy(F.col("e_source").alias("source")).agg(F.min(F.struct("bucket", self._at().alias("at"), "so_far", "limit", "size")).alias("f"))
        return first.select("source", "f.*")

    @staticmethod
    def _of(other: str) -> Column:
        return F.col("source").eqNullSafe(F.col(other))

    def ranked(self, rows: DataFrame) -> DataFrame:
        """rows with their source's plan, inclusion (the probability), rank and bucket (null: never sampled)."""
        wide = rows.join(self.plan, self._of("s_source"))
        wide = wide.withColumn("inclusion", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("factor") * weight(F.col("size")))))
        odds = F.col("inclusion") / (F.lit(1.0) - F.col("inclusion"))
        rank = F.when(F.col("inclusion") >= 1, F.lit(0.0)).when(F.col("inclusion") > 0, F.col("u") / (F.lit(1.0) - F.col("u")) / odds)
        wide = wide.withColumn("rank", rank)
        # A rising map of ranks to [0, 1); samples end near rank 1.
        return wide.withColumn("bucket", F.floor(F.lit(float(self.buckets)) * F.col("rank") / (F.col("rank") + 1)).cast("long"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows with ``copies``: how often the mix takes each."""
        wide = self.ranked(rows).join(self.cut, self._of("c_source"), "left")
        # Places are told apart by bucket first: a rank's bucket rises with it.
        place, cut, stop = (F.struct(F.col(b), a) for b, a in (("bucket", self._at()), ("edge", F.col("cut")), ("stop_edge", F.col("stop"))))
        behind = (place > cut) & (F.col("size") <= F.col("gap")) & (F.col("stop").isNull() | (place < stop))
        here = F.col("cut").isNull() | (place < cut) | F.when(F.col("fill"), behind).otherwise((place == cut) & F.col("itself"))
        sampled = (F.col("rest") > 0) & F.col("bucket").isNotNull() & here
        return wide.withColumn("copies", F.col("whole") + F.when(F.coalesce(sampled, F.lit(False)), F.lit(1)).otherwise(F.lit(0)))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Nulls, empty texts, equal rows and an empty table are as in ``mix``; columns may have any names. Texts are written
    once and never shuffled: each row finds its source's cut.
    """
    stash = Stash(docs.sparkSession, "mix")
    own = F.struct(*[column(c) for c in docs.columns]).alias("own")
    rows = stash.put("rows", docs.select(own, F.monotonically_increasing_id().alias("row")))
    sized = rows.select("own", "row", F.col("own.doc_id").alias("doc_id"), F.col("own.source").alias("source"), n_words("own.text").alias("size"), uniform(F.col("own.doc_id"), F.col("own.text")).alias("u"))
    slim = stash.put("sized", sized.drop("own"))
    taken = _Cuts(stash, slim, weights, total, most, BUCKETS).taken(sized).where("copies > 0")
    return taken.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")

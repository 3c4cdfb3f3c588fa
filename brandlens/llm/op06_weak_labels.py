"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts
of all vote patterns estimates each labeller's accuracy and the share of good documents; the posterior of a pattern
is a soft label. A linear scorer over hashed words is trained on a bounded sample of documents and their posteriors
and then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum
from .op09_rules import measures
from .storage import Stash


@dataclass(frozen=True)
class Labeller:
    """Votes good where the measure lies in one range, bad where it lies in another, else not at all."""

    name: str
    measure: str
    good: tuple[float, float]
    bad: tuple[float, float]
    #: Shorter texts get no vote.
    words: int = 1

    def vote(self) -> Column:
        m = F.col(f"_wl_{self.measure}")
        return F.when(F.col("_wl_n_words") < self.words, 0).when(m.between(*self.good), 1).when(m.between(*self.bad), -1).otherwise(0)


INF = float("inf")
#: A range that holds nothing: the labeller casts no such vote.
NEVER = (1.0, 0.0)
LABELLERS = (
    Labeller("stop_words", "stop_word_ratio", (0.12, 0.60), (0.0, 0.01), 30),
    Labeller("word_length", "mean_word_chars", (3.5, 7.0), (7.5, INF)),
    Labeller("repeats", "repeat_ratio", (0.0, 0.20), (0.50, 1.0)),
    Labeller("doubled", "doubled_ratio", (0.0, 0.02), (0.25, 1.0)),
    Labeller("symbols", "symbol_ratio", NEVER, (0.10, INF)),
    Labeller("bangs", "bang_ratio", NEVER, (0.30, INF)),
    Labeller("letters", "letter_ratio", NEVER, (0.0, 0.60), 30),
    Labeller("lines", "dup_line_ratio", NEVER, (0.50, 1.0), 30),
    Labeller("capitals", "upper_ratio", NEVER, (0.50, 1.0)),
)

#: Hashed features of the scorer; documents of each vote pattern and of the whole training sample, at most.
DIMENSIONS = 1 << 14
SAMPLE_A_PATTERN = 60
SAMPLE = 4000
MOST_CHARS = 20_000
PASSES = 30
#: Parts of a vote pattern that are ranked apart before its best rows are.
PARTS = 64
#: A document stays when the mean of its posterior and score reaches this.
KEEP = 0.4


def votes(docs: DataFrame, text: str = "text", labellers=LABELLERS) -> DataFrame:
    """docs with ``votes``, an array of -1, 0 and 1; built-in functions only."""
    t = F.coalesce(F.col(text), F.lit(""))
    wide = measures(docs, text, prefix="_wl_")
    letters, words = F.col("_wl_n_letters"), F.col("_wl_n_words")
    doubled = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"))
    wide = wide.withColumns(
        {
            "_wl_repeat_ratio": F.when(words > 0, F.col("_wl_n_repeat_words") / words).otherwise(0.0),
            "_wl_doubled_ratio": F.when(words > 0, doubled / words).otherwise(0.0),
            "_wl_upper_ratio": F.when(letters > 0, F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / letters).otherwise(0.0),
        }
    )
    return wide.withColumn("votes", F.array(*[x.vote().cast("tinyint") for x in labellers])).select(*docs.columns, "votes")


@dataclass
class LabelModel:
    """prior: share of good documents; table[k, c, v]: odds that labeller k votes v - 1 on class c (0 bad, 1 good)."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        logs = np.log(self.table)
        k = np.arange(patterns.shape[1])
        bad = np.log(1 - self.prior) + logs[k, 0, patterns + 1].sum(axis=1)
        good = np.log(self.prior) + logs[k, 1, patterns + 1].sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller: how often a vote it casts is right."""
        right = (1 - self.prior) * self.table[:, 0, 0] + self.prior * self.table[:, 1, 2]
        cast = right + (1 - self.prior) * self.table[:, 0, 2] + self.prior * self.table[:, 1, 0]
        return right / np.maximum(cast, 1e-12)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM for conditionally independent labellers, from the majority vote; at most 3 ** labellers patterns."""
    n_labellers = patterns.shape[1]
    good = np.where(patterns.sum(axis=1) > 0, 0.9, np.where(patterns.sum(axis=1) < 0, 0.1, 0.5))
    model = LabelModel(0.5, np.full((n_labellers, 2, 3), 1 / 3))
    for _ in range(rounds):
        table = np.empty((n_labellers, 2, 3))
        for v in range(3):
            hit = (patterns == v - 1).T * counts
            table[:, 0, v], table[:, 1, v] = hit @ (1 - good) + 1.0, hit @ good + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts @ good + 1.0) / (counts.sum() + 2.0), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, table)
        now = model.posterior(patterns)
        if np.abs(now - good).max(initial=0.0) < 1e-9:
            break
        good = now
    return model


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (as they are, marks and case included) of all texts, and of what their bytes are; bounds."""
    starts, ends, rows = textnum.words(buf, offsets)
    n = len(offsets) - 1
    word = textnum.hash_spans(buf, starts, ends)
    # The last byte and the case of the first tell junk from prose where the word itself is new.
    shape = textnum.mix((buf[ends - 1].astype(np.uint64) << np.uint64(9)) + (buf[starts].astype(np.uint64) < np.uint64(97)) + np.uint64(1 << 20)) if len(starts) else word
    bounds = textnum.row_bounds(rows, n)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    third = np.where(again, np.uint64(3), np.uint64(5))
    bucket = np.stack([word, shape, textnum.mix(third)], axis=1) % np.uint64(DIMENSIONS)
    return bucket.astype(np.int32).reshape(-1), bounds * 3


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of good: the mean weight of a text's features through a logistic curve; 0 without words."""
        bucket, bounds = features(buf, offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket])])
        n = np.diff(bounds)
        mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
        return np.where(n > 0, 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -500, 500))), 0.0)


def train(rows: list[tuple[str, float]], passes: int = PASSES, rate: float = 20.0) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps, the classes weighing the same."""
    rows = sorted(rows)
    weights, bias, seen = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-6)
    if not rows:
        return Scorer(weights, bias)
    texts = [t.encode("utf-8") for t, _ in rows]
    soft = np.array([p for _, p in rows])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bucket, bounds = features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    weight = soft / max(soft.sum(), 1e-9) + (1 - soft) / max((1 - soft).sum(), 1e-9)
    weight *= len(rows) / weight.sum()
    length = np.maximum(np.diff(bounds), 1)
    parts = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
    draw = np.random.default_rng(3)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            at, n = parts[i]
            x = n / length[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(weights[at] @ x + bias, -500, 500)))
            slope = weight[i] * (p - soft[i])
            seen[at] += (slope * x) ** 2
            weights[at] -= rate * 0.05 * slope * x / np.sqrt(seen[at])
            bias -= 0.02 * slope
    return Scorer(weights.astype(np.float64), float(bias))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, n_votes, posterior, score, kept for every row of docs.

    Patterns are counted over all documents; the driver gets one row a pattern. The sample for the scorer takes the
    rows with the least hashes of id and text of each pattern, SAMPLE_A_PATTERN of each and whole texts of up to
    MOST_CHARS; repeated rows count once. A pattern all of whose texts are longer trains nothing; its texts are still
    counted, judged and scored, whole. Rows whose hashes tie are taken together up to the next bound.
    ``kept``: the mean of posterior and score reaches ``keep``. A null or wordless text has no votes, score 0 and is
    not kept; equal texts get equal results; an empty table gives an empty result; other columns are not looked at.
    """
    stash = Stash(docs.sparkSession, "weak")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    voted = stash.put("votes", votes(rows).select("doc_id", F.xxhash64("text").alias("h"), F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), F.length("text").alias("n")))
    found = sorted(voted.groupBy("votes").count().collect())
    patterns = np.array([[int(v) for v in r[0].split(",")] for r in found], np.int64).reshape(len(found), len(LABELLERS))
    model = fit(patterns, np.array([r[1] for r in found], float))
    posterior = dict(zip([r[0] for r in found], model.posterior(patterns).tolist()))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.col("h"))
    # Of rows that repeat an id and text one can be drawn; patterns are ranked in parts, then the best of the parts.
    some = voted.where(F.col("n").between(1, MOST_CHARS)).select("h", "votes", draw.alias("draw"), F.pmod(draw, F.lit(PARTS)).alias("part"))
    best = lambda df, *by: df.withColumn("k", F.dense_rank().over(W.partitionBy(*by).orderBy("draw"))).where(F.col("k") <= SAMPLE_A_PATTERN)
    parts = some.groupBy("votes", "part", "draw", "h").count().drop("count")
    picked = best(best(parts, "votes", "part"), "votes").orderBy("draw", "h").limit(SAMPLE).select("votes", F.col("draw").alias("p_draw"), F.col("h").alias("p_h"))
    drawn = rows.select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")).alias("draw"))
    found = drawn.join(picked, (F.col("draw") == F.col("p_draw")) & (F.col("h") == F.col("p_h")))
    texts = found.groupBy("draw", "h").agg(F.first("votes").alias("votes"), F.first("text").alias("text")).collect()
    scorer = train([(r["text"], posterior[r["votes"]]) for r in texts])
    logs = np.log(model.table)
    odds = F.lit(float(np.log(model.prior) - np.log(1 - model.prior)))
    for k in range(len(LABELLERS)):
        step = F.array(*[F.lit(float(x)) for x in logs[k, 1] - logs[k, 0]])
        odds = odds + F.element_at(step, F.element_at("votes", k + 1).cast("int") + 2)
    split = F.split("votes", ",")
    voted = voted.select("doc_id", "h", split.alias("votes")).dropDuplicates(["doc_id", "h"])
    judged = voted.select(
        F.col("doc_id").alias("v_id"), F.col("h").alias("v_h"), F.size(F.filter("votes", lambda v: v != "0")).cast("long").alias("n_votes"), (1 / (1 + F.exp(-odds))).alias("posterior")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = [scorer.scores(buf, offsets) for _, _, buf, offsets in textnum.groups(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate([np.zeros(0), *sure]))], names=["doc_id", "h", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, score double")
    kept = ((F.col("posterior") + F.col("score")) / 2 >= keep) & (F.col("score") > 0)
    joined = scored.join(judged, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("h") == F.col("v_h")))
    return joined.select("doc_id", "n_votes", "posterior", "score", kept.alias("kept"))

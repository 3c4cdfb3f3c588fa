"""Language ID by hierarchical discrimination.

A linear model over hashed byte n-grams picks the language family first; inside the family, one-versus-one linear
support vector machines vote among the related languages. Training is on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import textnum
from .names import column, unused_prefix

#: Family of each language code; a code that is not here is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
}
#: Hash buckets of the 1-, 2- and 3-grams.
DIMENSIONS = 1 << 13
#: Bounds of the training sample: rows a language, rows in all (shared evenly by the languages, at least one each), and
#: characters of a row (longer rows are drawn only where a language has no others).
ROWS = 600
ALL_ROWS = 12_000
MOST_CHARS = 20_000
#: Languages up to which what is known of each is broadcast: a few hundred kilobytes.
FEW_LANGUAGES = 10_000
EPOCHS = 12
#: A document goes when its language's score is below this.
LEAST_SCORE = 0.15
UNKNOWN = "und"
#: Parts of a language that are ranked apart before its best rows are.
PARTS = 64
SEGMENT = 1 << 20

_GRAM = (textnum.spread(3, 5) | np.uint64(1)).astype(np.uint32)


def _letters() -> np.ndarray:
    """ASCII letters in lower case and bytes of other characters as they are; everything else is a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


_CLEAN = _letters()


def grams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the 1-, 2- and 3-gram that ends at each byte, shape (3, bytes); spaces stand before the first."""
    text = _CLEAN[buf].astype(np.uint32)
    out = np.empty((3, len(text)), np.int32)
    shift, total = np.uint32(32 - 13), np.zeros(len(text), np.uint32)
    for k in range(3):
        moved = np.full(len(text), 32, np.uint32)
        moved[k:] = text[: len(text) - k]
        total = total + (moved + np.uint32(1)) * _GRAM[k]
        out[k] = ((total ^ (total >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(k * 77)) >> shift
    return out


@dataclass
class Model:
    """weights: (dimensions, lines); families: names and columns; pairs: (language, language, column)."""

    languages: list[str]
    families: dict[str, list[str]]
    names: list[str]
    pairs: list[tuple[str, str, int]]
    weights: np.ndarray
    bias: np.ndarray
    scale: float


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM by dual coordinate descent; rows of x have length 1; the bias is one more feature."""
    n = len(y)
    norm = (x * x).sum(axis=1) + 1.0
    w, b, alpha = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(n)
    order = np.random.default_rng(7)
    weight = c * n / (2.0 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    for _ in range(epochs):
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w + b) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                b += step
                alpha[i] = new
    return w, b


def features(texts: Sequence[str]) -> np.ndarray:
    """n-gram counts of each text as a row of length 1."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        buf = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(buf):
            out[i] = np.bincount(grams(buf).ravel(), minlength=DIMENSIONS)
            out[i] /= np.linalg.norm(out[i])
    return out


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows, sorted so that equal input gives an equal model."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    languages = sorted({lang for _, lang in rows})
    x, lang = features([t for t, _ in rows]), np.array([g for _, g in rows])
    families: dict[str, list[str]] = {}
    for g in languages:
        families.setdefault(family_of(g), []).append(g)
    lines: list[tuple[np.ndarray, float]] = []
    names = sorted(families)
    if len(names) > 1:
        kin = np.array([family_of(g) for g in lang])
        lines = [_svm(x, np.where(kin == f, 1.0, -1.0)) for f in names]
    pairs = []
    for f in names:
        for i, a in enumerate(families[f]):
            for b in families[f][i + 1 :]:
                use = (lang == a) | (lang == b)
                pairs.append((a, b, len(lines)))
                lines.append(_svm(x[use], np.where(lang[use] == a, 1.0, -1.0)))
    weights = np.stack([w for w, _ in lines], axis=1).astype(np.float32) if lines else np.zeros((DIMENSIONS, 0), np.float32)
    return Model(languages, families, names, pairs, weights, np.array([b for _, b in lines], np.float64), 3.0)


def margins(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines' values for each text. Long texts are read in segments; sums and norms are over the whole."""
    n = len(offsets) - 1
    out = np.zeros((n, model.weights.shape[1]))
    for i in range(n):
        counts = np.zeros(DIMENSIONS)
        for low in range(offsets[i], offsets[i + 1], SEGMENT):
            high = min(low + SEGMENT, offsets[i + 1])
            begin = max(offsets[i], low - 2)
            found = grams(buf[begin:high])[:, low - begin :]
            counts += np.bincount(found.ravel(), minlength=DIMENSIONS)
        norm = np.linalg.norm(counts)
        if norm:
            out[i] = counts @ model.weights / norm
    return out + model.bias


def predict(model: Model, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row of margins; the score multiplies the family's and the weakest vote's odds."""
    n = len(values)
    sure = lambda m: 1.0 / (1.0 + np.exp(-model.scale * np.clip(m, -30, 30)))
    best = values[:, : len(model.names)].argmax(axis=1) if len(model.names) > 1 else np.zeros(n, int)
    score = sure(values[np.arange(n), best]) if len(model.names) > 1 else np.ones(n)
    out = np.full(n, UNKNOWN, object)
    for k, family in enumerate(model.names):
        rows = np.flatnonzero(best == k)
        members = model.families[family]
        votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), 1.0)
        for a, b, line in model.pairs:
            if a in members:
                i, j, p = members.index(a), members.index(b), sure(values[rows, line])
                votes[:, i] += (p >= 0.5) + 1e-3 * p
                votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        top = votes.argmax(axis=1)
        out[rows] = np.array(members, object)[top]
        score[rows] *= least[np.arange(len(rows)), top]
    return out, score


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % 3 == 1


def sample(labelled: DataFrame, rows: int = ROWS, most_chars: int = MOST_CHARS, all_rows: int = ALL_ROWS) -> list[tuple[str, str]]:
    """Texts of at most ``rows`` rows of every language, and of about ``all_rows`` in all: those with the least hashes
    of id and text. Texts above ``most_chars`` come last and are cut there.

    The bounds hold whatever the ids: of equal hashes no more than ``rows`` are taken. Ranks are made in two steps,
    within parts of a language and then among the best of its parts, so that no task sees all rows of a language.
    What comes to the driver is a row a language, and the sample.
    """
    few = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", F.substring("text", 1, most_chars).alias("text"), F.struct(F.length("text") > most_chars, F.xxhash64(F.col("doc_id").cast("string"), "text")).alias("draw")
    )
    rows = max(1, min(rows, all_rows // max(1, few.agg(F.count_distinct("lang")).first()[0])))
    slim = few.select("lang", "draw", F.pmod(F.xxhash64("draw"), F.lit(PARTS)).alias("part"))
    best = lambda df, *by: df.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("draw"))).where(F.col("k") <= rows)
    ends = best(best(slim, "lang", "part"), "lang").groupBy("lang").agg(F.max("draw").alias("end"))
    found = ends.collect()
    known = labelled.sparkSession.createDataFrame(found, ends.schema)
    # A row a language. While they are few they are broadcast, and no texts move; otherwise texts are dealt out by language.
    inside = few.join(F.broadcast(known) if len(found) <= FEW_LANGUAGES else known, "lang").where("draw <= end")
    # Below the last hash there are fewer than ``rows``; rows that share it are ranked once more.
    spread = inside.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    return [(r["text"], r["lang"]) for r in best(best(spread, "lang", "part"), "lang").select("lang", "text").collect()]


def classify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs plus ``lang_pred`` and ``score`` under a prefix (replacing columns of those names).

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned. Of equal
    margins or votes the first language by name is taken.
    Prediction reads the whole text and nothing else; equal texts get equal results.
    """
    ship(docs.sparkSession)
    lang, score = f"{prefix}lang_pred", f"{prefix}score"
    rest = [c for c in docs.columns if c not in (lang, score)]
    readable = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`"))
    # Columns go to Python by place: their names may hold dots.
    given = docs.select(readable.alias("read"), *[column(c).alias(f"c{k}") for k, c in enumerate(rest)])
    places = given.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            names, scores = [], []
            for _, _, buf, offsets in textnum.groups(column):
                found, sure = predict(model, margins(model, buf, offsets))
                names.append(found)
                scores.append(sure)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            name = np.concatenate([np.zeros(0, object), *names])
            sure = np.concatenate([np.zeros(0), *scores])
            name[missing], sure[missing] = UNKNOWN, 0.0
            if not model.languages:
                name[:], sure[:] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(name, pa.string()), pa.array(sure)], names=[*places, "lang", "score"]
            )

    schema = T.StructType([*given.schema.fields[1:], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema).toDF(*rest, lang, score)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, trained on the rows that are not held out.

    lang serves as the label of training rows only (null: not a label); neither it nor the id is an input of a
    prediction. An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    model = train(sample(rows.where(~F.col("held_out"))))
    return classify(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_documents(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language that was learned, with their own columns; ``und`` and unsure ones go.

    A text that is null, empty or without letters goes, as do all where nothing was learned; a null lang or id is no
    hindrance to stay. Equal rows stay or go together; an empty table gives an empty result; columns may have any
    names.
    """
    model = train(sample(docs.where(~held_out())))
    prefix = unused_prefix(docs.columns, "_id_")
    out = classify(docs, model, prefix=prefix)
    good = (F.col(f"`{prefix}lang_pred`") != UNKNOWN) & (F.col(f"`{prefix}score`") >= least)
    return out.where(good).select(*[column(c) for c in docs.columns])

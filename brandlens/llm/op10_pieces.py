"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a space in front, every space is a white-space marker, and the best-scoring sequence of pieces is
chosen. A character that is no piece costs ten below the worst score and becomes its UTF-8 bytes as byte pieces.
Decoding joins pieces and bytes, turns markers into spaces and takes the space in front away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textnum
from .lattice import DoubleArray, Vocabulary, blocks, gather, lattice_of, load_vocabulary

#: Score of a character that is no piece, below the worst piece.
UNKNOWN_BELOW = 10.0
#: Bytes of text whose equal units are segmented once.
GROUP = 3 << 20


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = DoubleArray(vocabulary.pieces)
        text = np.array([p is not None for p in vocabulary.pieces])
        self.scores = np.append(np.where(text, vocabulary.scores, 0.0), vocabulary.scores[text].min() - UNKNOWN_BELOW)
        self.lost = len(vocabulary.pieces)
        shown = [p or b"" for p in vocabulary.pieces]
        for byte, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                shown[i] = bytes([byte])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_bounds = np.concatenate([[0], np.cumsum([len(p) for p in shown])])

    def units(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each of the strings, and their bounds."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in blocks(bounds):
            part = buf[bounds[low] : bounds[high]]
            lattice = lattice_of(self.trie, part, bounds[low : high + 1] - bounds[low], unknown=self.lost)
            piece, first, end, cuts = lattice.spelled(self.scores)
            width = np.where(piece == self.lost, end - first, 1)
            starts = np.concatenate([[0], np.cumsum(width)])
            out = np.repeat(piece, width)
            lost = out == self.lost
            if lost.any():
                at = np.repeat(first, width) + np.arange(len(out)) - np.repeat(starts[:-1], width)
                spelled = self.vocabulary.byte_ids[part[at[lost]]]
                out[lost] = np.where(spelled >= 0, spelled, self.vocabulary.unknown)
            ids.append(out)
            counts.append(np.diff(starts[cuts]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of texts laid end to end, and each text's bounds. Equal units are segmented once."""
        n = len(offsets) - 1
        full, at = gather(buf, offsets[:-1], offsets[1:], head=32)
        empty = np.diff(offsets) == 0
        keep = np.ones(len(full), bool)
        keep[at[:-1][empty]] = False
        full = full[keep]
        at = np.concatenate([[0], np.cumsum(np.where(empty, 0, np.diff(at)))])
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        space = full == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[at[:-1][~empty]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(full))
        _, one, which = np.unique(textnum.hash_spans(full, starts, ends), return_index=True, return_inverse=True)
        ids, bounds = self.units(*gather(full, starts[one], ends[one]))
        out, cuts = gather(ids, bounds[which], bounds[which + 1])
        return out, cuts[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of id sequences, laid end to end, and their bounds."""
        text, cuts = gather(self.shown, self.shown_bounds[ids], self.shown_bounds[ids + 1])
        at = cuts[bounds]
        first = at[:-1][np.diff(at) > 0]
        keep = np.ones(len(text), bool)
        keep[first[text[first] == 32]] = False
        return text[keep], np.concatenate([[0], np.cumsum(keep)])[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_vocabulary(path))
    return _ENCODERS[path]


def _ship(df: DataFrame, vocabulary: str) -> str:
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pieces array<int>, n_bytes, n_byte_pieces, exact for every row of docs.

    ``exact`` says that decoding the pieces gives the text back; it fails where the text holds the marker character
    itself, which stands for a space, and where a character is no piece and the vocabulary has no byte pieces. Null and empty texts have no pieces; equal rows get equal rows; an
    empty table gives an empty result; other columns are not looked at.
    """
    name = _ship(docs, vocabulary)
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.replace(F.col(f"`{text}`"), F.lit("▁"), F.lit(" ")).alias("spaced"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(SparkFiles.get(name))
        low_byte = np.zeros(len(machine.scores), bool)
        low_byte[machine.vocabulary.byte_ids[machine.vocabulary.byte_ids >= 0]] = True
        for batch in batches:
            for low, high, buf, offsets in textnum.groups(batch.column(2), GROUP):
                ids, bounds = machine.encode(buf, offsets)
                again, cuts = machine.decode(ids, bounds)
                same = np.diff(cuts) == np.diff(offsets)
                if len(again) == len(buf) and (cuts == offsets).all():
                    wrong = np.flatnonzero(again != buf)
                    same[np.searchsorted(offsets, wrong, side="right") - 1] = False
                else:
                    same = np.array([again[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(cuts[:-1], cuts[1:], offsets[:-1], offsets[1:])])
                given, spaced = (batch.column(k).slice(low, high - low).fill_null("") for k in (1, 2))
                spelled = np.concatenate([[0], np.cumsum(low_byte[ids])])[bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.compute.binary_length(given).cast(pa.int64()),
                        pa.array(np.diff(spelled)),
                        pa.compute.and_(pa.compute.equal(given, spaced), pa.array(same)),
                    ],
                    names=["doc_id", "pieces", "n_bytes", "n_byte_pieces", "exact"],
                )

    return slim.mapInArrow(run, f"doc_id {kind}, pieces array<int>, n_bytes long, n_byte_pieces long, exact boolean")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """doc_id, text for every row: the text of its pieces (null and empty: empty text)."""
    name = _ship(encoded, vocabulary)
    slim = encoded.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{pieces}`"), F.array().cast("array<int>")).alias("pieces"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(SparkFiles.get(name))
        for batch in batches:
            column = batch.column(1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            text, cuts = machine.decode(column.flatten().to_numpy().astype(np.int64), bounds - bounds[0])
            whole = text.tobytes()
            out = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_byte_pieces, pieces_crc32 (of the ids joined by commas), exact."""
    return encoded.select(
        "doc_id",
        "n_bytes",
        F.size("pieces").cast("long").alias("n_pieces"),
        "n_byte_pieces",
        F.crc32(F.array_join(F.col("pieces").cast("array<string>"), ",")).alias("pieces_crc32"),
        "exact",
    )

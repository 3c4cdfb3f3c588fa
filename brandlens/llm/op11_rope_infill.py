"""Fill-in-middle transformation on ropes.

A rope is a binary tree over pieces of a text; a leaf caches how many units begin in it and how many code points it
has, an inner node the sums of both. A text is cut by splitting its tree at two unit ranks, the three subtrees are put
together in another order with sentinels between them, and the text is rebuilt by finding the sentinels in the tree of
the output and splitting it there. A split costs the depth of the tree and one leaf; no token list is ever made.

Defined results: a null text is empty, an empty text is plain; a null id is drawn as empty decimals; equal rows get
equal results; a text that holds a sentinel is plain, so every output can be inverted; an empty table gives an empty
result; other columns are not looked at and may have any names. Texts are handled one by one, whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of 100 that are rearranged, and of these those in suffix-prefix-middle order.
CHANGED_PERCENT, SPM_PERCENT = 90, 20
#: Code points of a leaf, and characters of an output batch.
LEAF = 2048
BATCH_CHARS = 4 << 20


@dataclass(frozen=True, slots=True)
class Leaf:
    """A piece of text; ``inside`` says that its first letter continues the run of letters before it."""

    text: str
    inside: bool
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int


Rope = Leaf | Node | None


def unit_starts(text: str, inside: bool) -> np.ndarray:
    """Where units of ``[A-Za-z]+|[^A-Za-z]`` begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) - 97) < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    if inside and len(points) and letter[0]:
        begins[0] = False
    return np.flatnonzero(begins)


def leaf(text: str, inside: bool = False) -> Leaf | None:
    return Leaf(text, inside, len(unit_starts(text, inside)), len(text)) if text else None


def _ends_in_letter(text: str) -> bool:
    return text[-1:].isascii() and text[-1:].isalpha()


def rope(text: str) -> Rope:
    """A balanced tree over pieces of LEAF code points."""
    level: list = []
    inside = False
    for at in range(0, len(text), LEAF):
        piece = text[at : at + LEAF]
        level.append(leaf(piece, inside))
        inside = _ends_in_letter(piece)
    while len(level) > 1:
        level = [join(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0] if level else None


def join(*parts: Rope) -> Rope:
    """Trees one after the other. The number of parts is fixed, so the depth stays logarithmic."""
    whole = None
    for part in parts:
        if whole is None or part is None:
            whole = part if whole is None else whole
        else:
            whole = Node(whole, part, whole.units + part.units, whole.chars + part.chars)
    return whole


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if tree is None or rank >= tree.units and isinstance(tree, Leaf):
        return tree, None
    if isinstance(tree, Leaf):
        return _cut(tree, int(unit_starts(tree.text, tree.inside)[rank]))
    # A right subtree may begin inside the last unit of the left one: at equal ranks the cut lies in it.
    if rank < tree.left.units:
        first, rest = split_units(tree.left, rank)
        return first, join(rest, tree.right)
    first, rest = split_units(tree.right, rank - tree.left.units)
    return join(tree.left, first), rest


def split_chars(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first ``at`` code points, and the rest."""
    if tree is None or at >= tree.chars:
        return tree, None
    if isinstance(tree, Leaf):
        return _cut(tree, at)
    if at < tree.left.chars:
        first, rest = split_chars(tree.left, at)
        return first, join(rest, tree.right)
    first, rest = split_chars(tree.right, at - tree.left.chars)
    return join(tree.left, first), rest


def _cut(piece: Leaf, at: int) -> tuple[Rope, Rope]:
    before = piece.text[:at]
    return leaf(before, piece.inside), leaf(piece.text[at:], _ends_in_letter(before) if before else piece.inside)


def pieces(tree: Rope) -> Iterator[str]:
    """The texts of the leaves in order."""
    open_ = [tree] if tree is not None else []
    while open_:
        top = open_.pop()
        if isinstance(top, Leaf):
            yield top.text
        else:
            open_ += [top.right, top.left]


def flat(tree: Rope) -> str:
    return "".join(pieces(tree))


def find(tree: Rope, needle: str) -> int | None:
    """The code point at which the first ``needle`` begins, though it may lie across leaves."""
    seen, tail = 0, ""
    for piece in pieces(tree):
        at = (tail + piece).find(needle)
        if at >= 0:
            return seen - len(tail) + at
        seen += len(piece)
        tail = (tail + piece)[1 - len(needle) :]
    return None


def rearrange(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle or none, output)."""
    tree = rope(text)
    n = tree.units if tree else 0
    if not text or h3 % 100 >= CHANGED_PERCENT or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split_units(tree, second)
    prefix, middle = split_units(head, first)
    p, s, m = leaf(PREFIX), leaf(SUFFIX), leaf(MIDDLE)
    if h4 % 100 < SPM_PERCENT:
        form, out = "spm", join(s, suffix, p, prefix, m, middle)
    else:
        form, out = "psm", join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, flat(out)


def restore_text(output: str, form: str) -> str:
    """The text of which ``rearrange`` made the output."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, part, before = rope(output), {}, None
    for mark in order:
        part[before], rest = split_chars(rest, find(rest, mark))
        _, rest = split_chars(rest, len(mark))
        before = mark
    part[before] = rest
    return flat(join(part[PREFIX], part[MIDDLE], part[SUFFIX]))


def draws(key: Column) -> list[Column]:
    """h1 to h4 of an id: the first four 32-bit groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row."""
    ship(docs.sparkSession)
    id_ = F.col(f"`{key}`")
    slim = docs.select(id_.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *draws(id_))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [batch.column(k).to_pylist() for k in range(2, 6)]
            for low, high, texts in _bounded(batch.column(1)):
                rows = [rearrange(t, *h) for t, *h in zip(texts, *[h[low:high] for h in hashes])]
                n, form, prefix, middle, out = zip(*rows)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with columns output and form) and the text rebuilt from these two alone, as ``restored``."""
    ship(outputs.sparkSession)
    # Columns go to Python by place: their names may hold dots.
    given = outputs.toDF(*[f"c{k}" for k in range(len(outputs.columns))])
    names = [*given.columns, "restored"]
    form_at, output_at = outputs.columns.index("form"), outputs.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(form_at).to_pylist()
            for low, high, texts in _bounded(batch.column(output_at)):
                again = [restore_text(t, f) for t, f in zip(texts, forms[low:high])]
                kept = [c.slice(low, high - low) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(again, pa.string())], names=names)

    found = given.mapInArrow(run, type(given.schema)(list(given.schema.fields)).add("restored", "string"))
    return found.toDF(*outputs.columns, "restored")


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of runs of rows of about BATCH_CHARS bytes, at least one row each."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for k, size in enumerate(sizes):
        if k > low and total + size > BATCH_CHARS:
            yield low, k, texts.slice(low, k - low).to_pylist()
            low, total = k, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes), texts.slice(low).to_pylist()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and SHA-256 of the output and of what is rebuilt from it."""
    hashed = [F.sha2(F.col(c), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)

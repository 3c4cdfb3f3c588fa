"""Token counts by a compiled finite-state tokenizer.

The splitting pattern of byte-level BPE looks at no more than a few neighbouring characters, so its automaton is a
sliding window over character classes. Inside a piece the merges are a deterministic transducer over bytes: a state
holds, for each suffix that may still grow into a token, the token before that suffix, and every transition carries
the change in the number of emitted tokens. States are made when first met and kept in one table, which starts anew
when it is full. Texts are cut into chunks of equal length that advance together, each from the state in which a piece
begins. A chunk's state map takes the states in which it may be entered to those in which it ends, with the changes on
the way; a map that holds a piece start is constant. Entries are the ends of the chunk before: maps grow, all at once,
until every end of a map is an entry of the next one. Then the maps are composed by a parallel prefix scan, in as many
steps as the logarithm of the chunks of a piece, which tells the state in which each chunk really is entered.

It rests on a property of BPE: a token sequence is the encoding of its bytes exactly if each adjacent pair is the
encoding of its own bytes.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..shipping import ship
from . import textnum

#: Bytes of a chunk; states kept before the table starts anew (1.3 kB each).
CHUNK = 128
#: Bytes that the lanes hold at once, but for a longer piece.
SEGMENT = 1 << 20
MOST_STATES = 1 << 17
START, DEAD = 0, 1
#: A node from which at most so many tokens can grow tells apart only what matters to them.
FEW = 6
NONE = -2

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
_CLASSES: list[np.ndarray] = []
#: White space of the pattern, beside the Unicode separators.
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def char_classes() -> np.ndarray:
    """Class of each code point."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[list(_WHITE)] = WHITE
        table[0x20] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the bytes at which a piece of the splitting pattern begins; offsets bound independent texts."""
    mark = np.zeros(len(buf), bool)
    if not len(buf):
        return mark
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    n = len(kind)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    first, final = first[:n], first[1:].copy()
    final[-1] = True
    before = np.empty_like(kind)
    before[1:], before[0] = kind[:-1], OTHER
    white, was_white = kind >= SPACE, before >= SPACE
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~white[1:]
    next_solid &= ~final
    start = first | np.where(white, ~was_white | next_solid, np.where(was_white, before == WHITE, before != kind))
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        room = np.flatnonzero(final)
        left = room[np.searchsorted(room, quotes)] - quotes
        at = lambda k: points[np.minimum(quotes + k, n - 1)]
        short = (left >= 1) & np.isin(at(1), [ord(c) for c in "stmd"])
        pair = (at(1) << np.uint32(8)) | at(2)
        long = (left >= 2) & np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        start[quotes[short | long] + 1] = False
        for found, length in ((short, 2), (long, 3)):
            after = quotes[found & (left >= length)] + length
            start[after] = True
    mark[lead[start]] = True
    return mark


class Transducer:
    """Merges of a byte-level BPE vocabulary as a lazily built table of (next state, change in tokens)."""

    def __init__(self, spec: dict, most_states: int = MOST_STATES):
        model = spec["model"]
        shown = _shown_bytes()
        raw = lambda token: bytes(shown[c] for c in token)
        self.tokens = {raw(t): i for t, i in model["vocab"].items() if all(c in shown for c in t)}
        self.bytes = {i: t for t, i in self.tokens.items()}
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[raw(left), raw(right)] = rank
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.most_states = most_states
        #: Arrays of states that are renumbered when the table starts anew.
        self.pinned: list[np.ndarray] = []
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in self.tokens.items():
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = self.trie[node][b]
            self.ends[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int] = {}
        self.likes: dict[tuple, int] = {}
        #: Tokens that a node may still grow into, where they are few.
        self.below: list[list[int] | None] = [None] * len(self.trie)
        for node in range(len(self.trie) - 1, -1, -1):
            found: list[int] = []
            for child in self.trie[node].values():
                found += [self.ends[child]] if self.ends[child] >= 0 else []
                found += self.below[child] or ([] if not self.trie[child] else [-1] * (FEW + 1))
            self.below[node] = found if len(found) <= FEW else None
        self._empty()

    def _empty(self) -> None:
        self.next = np.full((4096, 256), -1, np.int32)
        self.change = np.zeros((4096, 256), np.int8)
        self.next[DEAD] = DEAD
        root = ((0, -1, 0),)
        self.keys: list[tuple] = [root, ()]
        self.ids = {root: START}

    def merge(self, text: bytes) -> list[bytes]:
        """Plain merging, for the pairs of tokens that states need."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: nothing) in an encoding."""
        key = (before, token)
        if key not in self.pairs:
            parts = ([self.bytes[before]] if before >= 0 else []) + [self.bytes[token]]
            self.pairs[key] = self.merge(b"".join(parts)) == parts
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
                return self.fits(before, token)
        return self.pairs[key]

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if found == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return found

    def like(self, node: int, before: int) -> int | None:
        """The token that stands for before at a node: two after which the same tokens fit are one. None if none fits."""
        few = self.below[node]
        if few is None:
            return before
        key = (node, before)
        if key not in self.alike:
            fit = tuple(self.fits(before, t) for t in few)
            self.alike[key] = self.likes.setdefault((node, fit), before) if any(fit) else NONE
            if len(self.alike) > 2_000_000:
                self.alike = {}
                return self.like(node, before)
        found = self.alike[key]
        return None if found == NONE else found

    def learn(self, state: int, byte: int) -> None:
        """Makes one transition."""
        grown, token, tokens = [], -1, 0
        for node, before, count in self.keys[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            if token < 0 and self.ends[child] >= 0 and self.fits(before, self.ends[child]):
                token, tokens = self.ends[child], count + 1
            if self.trie[child] and (stands := self.like(child, before)) is not None:
                grown.append((child, stands, count))
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*((node, before, count - tokens) for node, before, count in grown), (0, token, 0))
        found = self._state(key)
        self.next[state, byte], self.change[state, byte] = found, tokens

    def step(self, states: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each lane: the next states and changes."""
        at = states * 256 + column
        after = self.next.ravel()[at]
        if after.min(initial=0) < 0:
            if len(self.keys) > self.most_states:
                states = self._anew(states)
                at = states * 256 + column
                after = self.next.ravel()[at]
            for x in np.unique(at[after < 0]):
                self.learn(int(x) >> 8, int(x) & 255)
            after = self.next.ravel()[at]
        return after, self.change.ravel()[at]

    def _anew(self, states: np.ndarray) -> np.ndarray:
        """Empties the table but for the states in use and those pinned; the new numbers of those in use."""
        live, place = np.unique(np.concatenate([states, *self.pinned]), return_inverse=True)
        keys = [self.keys[i] for i in live]
        self._empty()
        fresh, low = np.array([DEAD if not k else self._state(k) for k in keys], states.dtype)[place], len(states)
        for pin in self.pinned:
            pin[:] = fresh[low : low + len(pin)]
            low += len(pin)
        return fresh[: len(states)]

    def changes(self, buf: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """For each byte, the change in the number of tokens; starts marks the pieces, the first byte begins one."""
        n = len(buf)
        lanes = -(-n // chunk)
        pad = lanes * chunk - n
        text = np.concatenate([buf, np.zeros(pad, np.uint8)]).reshape(lanes, chunk).T.astype(np.int64)
        mark = np.concatenate([starts, np.ones(pad, bool)]).reshape(lanes, chunk).T.copy()
        out = np.zeros((chunk, lanes), np.int8)
        states = np.full(lanes, START, np.int64)
        for j in range(chunk):
            states, out[j] = self.step(np.where(mark[j], START, states), text[j])
        # Maps are needed of the bytes before a chunk's first piece start, where there are any.
        head = np.where(mark.any(axis=0), mark.argmax(axis=0), chunk)
        waits = np.flatnonzero(head > 0)
        if len(waits):
            self._resolve(text, head, waits, states.astype(np.int64), out)
        return out.T.reshape(-1)[:n]

    def _resolve(self, text: np.ndarray, head: np.ndarray, waits: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        """Puts the changes of the bytes before each waiting chunk's first piece start right. ends: of all chunks, had
        they begun a piece."""
        chunk, lanes = out.shape
        through = head == chunk
        # A link of a map: a chunk, an entry, the end it leads to (its own where a piece starts in it), the changes.
        lane, entry = waits, ends[waits - 1]
        all_lane, all_entry, all_end, all_steps = [], [], [], []
        known = {(int(x), self.keys[e]) for x, e in zip(lane, entry)}
        while len(lane):
            self.pinned = [ends, entry, *all_entry, *all_end]
            end, steps = self._heads(text, head, lane, entry)
            all_lane.append(lane)
            all_entry.append(entry)
            all_end.append(end)
            all_steps.append(steps)
            # Ends of maps without a piece start that the next chunk's map does not take yet.
            on = np.flatnonzero(through[lane] & (lane + 1 < lanes))
            on = on[head[lane[on] + 1] > 0]
            new = [i for i in on if (key := (int(lane[i]) + 1, self.keys[end[i]])) not in known and not known.add(key)]
            lane, entry = lane[new] + 1, end[new]
        self.pinned = []
        lane, entry, end = np.concatenate(all_lane), np.concatenate(all_entry), np.concatenate(all_end)
        steps = np.concatenate(all_steps, axis=1)
        # Links in order of chunk and entry; the link that each leads to, or a last one that leads to itself.
        order = np.lexsort((entry, lane))
        wide = np.int64(len(self.keys))
        key = lane[order] * wide + entry[order]
        goal = np.where(through[lane[order]], (lane[order] + 1) * wide + end[order], -1)
        at = np.minimum(np.searchsorted(key, goal), len(key) - 1)
        jump = np.append(np.where(key[at] == goal, at, len(key)), len(key))
        # A chunk behind one with a piece start is entered as assumed; the scan doubles its reach each step.
        first = ~through[lane[order] - 1]
        real = np.append(first & (entry[order] == ends[lane[order] - 1]), False)
        while True:
            reached = real.copy()
            reached[jump[real]] = True
            reached[-1] = False
            if (reached == real).all() and (jump[:-1] == len(key)).all():
                break
            real, jump = reached, jump[jump]
        chosen = order[real[:-1]]
        for x, j in zip(lane[chosen], chosen):
            out[: head[x], x] = steps[: head[x], j]

    def _heads(self, text: np.ndarray, head: np.ndarray, lane: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the bytes before each chunk's first piece start, from the given entries, and the changes."""
        end, steps = entry.copy(), np.zeros((len(text), len(lane)), np.int8)
        self.pinned.append(end)
        live = np.arange(len(lane))
        for j in range(int(head[lane].max())):
            live = live[head[lane[live]] > j]
            states, steps[j, live] = self.step(end[live], text[j, lane[live]])
            end[live] = states
        return end, steps

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text. A special string is one token and splits its text."""
        if not len(buf):
            return np.zeros(len(offsets) - 1, np.int64)
        spans = [s for t in self.special for s in _spans(buf, offsets, t)]
        cuts = np.unique(np.concatenate([offsets, *([np.array(spans).ravel()] if spans else [])]))
        starts = piece_starts(buf, cuts)
        change, low = np.zeros(len(buf), np.int64), 0
        while low < len(buf):
            later = low + SEGMENT
            high = later + int(starts[later:].argmax()) if later < len(buf) and starts[later:].any() else len(buf)
            change[low:high] = self.changes(buf[low:high], starts[low:high])
            low = high
        for low, high in spans:
            change[low:high] = 0
            change[low] = 1
        total = np.concatenate([[0], np.cumsum(change)])
        return total[offsets[1:]] - total[offsets[:-1]]


def _spans(buf: np.ndarray, offsets: np.ndarray, token: bytes) -> Iterator[tuple[int, int]]:
    text, at = buf.tobytes(), 0
    while (at := text.find(token, at)) >= 0:
        end = at + len(token)
        row = np.searchsorted(offsets, at, side="right")
        if row >= len(offsets) or end <= offsets[row]:
            yield at, end
            at = end
        else:
            at += 1


def _shown_bytes() -> dict[str, int]:
    """Byte of each character that stands for one in the vocabulary file: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process and file."""
    if path not in _COMPILED:
        with open(path, encoding="utf-8") as f:
            _COMPILED[path] = Transducer(json.load(f))
    return _COMPILED[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    ``vocabulary`` is a tokenizer file (JSON, byte-level BPE, no normalizer), shipped to the executors. Null text
    counts as empty: 0 bytes, 0 tokens. Long texts are handled in chunks like all others; a single piece of the splitter
    (one run of letters, say) above SEGMENT bytes is held whole, some tens of bytes of memory a byte; equal rows get equal
    rows; an empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    context.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(SparkFiles.get(name))
        for batch in batches:
            sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offsets in textnum.groups(batch.column(1), 1 << 20):
                sizes.append(np.diff(offsets))
                tokens.append(machine.counts(buf, offsets))
            n_tokens = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

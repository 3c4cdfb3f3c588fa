"""Subword lattices: a double-array trie of pieces, and recursions over all segmentations of many strings at once.

Inside strings a space stands for the white-space marker of the vocabulary. Pieces hold it only at their start,
so a text's lattice falls apart into independent units, each a run of spaces with what follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import exp, log1p

import numpy as np

MARKER = "▁"
#: Bytes of units whose lattice is held at once.
BLOCK = 1 << 18
#: Bytes above which a string is walked by itself, and of a stretch of it whose edges are held at once.
LONE = 1 << 12
STRETCH = 1 << 16


@dataclass
class Vocabulary:
    """pieces in id order as bytes (None: not a text piece), their log scores, and the ids of single bytes."""

    pieces: list[bytes | None]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int


def load_vocabulary(path: str) -> Vocabulary:
    """A piece file. Where its scores are merge ranks instead of log probabilities, Zipf's law over the ranks
    stands in: the piece of rank r gets -log(r + 1) less a constant that makes the probabilities sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = [None if special[i] else model.id_to_piece(i).replace(MARKER, " ").encode("utf-8") for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)], np.float64)
    text = np.array([p is not None for p in pieces])
    if (scores[text] == np.round(scores[text])).all():
        ranks = np.cumsum(text)[text]
        scores[:] = 0.0
        scores[text] = -np.log(ranks) - np.log((1.0 / ranks).sum())
    byte_ids = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
    return Vocabulary(pieces, scores, byte_ids, model.unk_id())


class DoubleArray:
    """A trie in two arrays: the child of s by byte c is base[s] + c where check of that is s."""

    def __init__(self, keys: Sequence[bytes | None]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, key in enumerate(keys):
            if not key:
                continue
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            if ends[node] < 0:
                ends[node] = i
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0], free, top = 1, 1, 1
        value[0] = ends[0]
        waiting = [(0, 0)]
        while waiting:
            node, at = waiting.pop()
            if not children[node]:
                continue
            codes = sorted(children[node])
            # Several children go behind all others; only children fill the gaps that those leave.
            start = max(top - codes[0], 1)
            if len(codes) == 1:
                while used[free] or free <= codes[0]:
                    free += 1
                start = free - codes[0]
            if start + 1024 > len(used):
                grow = len(used)
                used.extend(bytes(grow))
                base, check, value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
            base[at] = start
            for c in codes:
                used[start + c] = 1
                check[start + c], value[start + c] = at, ends[children[node][c]]
                waiting.append((children[node][c], start + c))
            top = max(top, start + codes[-1] + 1)
        self.base, self.check, self.value = base, check, value
        self.longest = max((len(k) for k in keys if k), default=1)

    def edges(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in buf that stay below the end given for each byte: first byte, end, id."""
        begin = np.arange(len(buf))
        state = np.zeros(len(buf), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        length = 0
        while len(begin):
            child = self.base[state] + buf[begin + length]
            live = self.check[child] == state
            live &= child > 0
            begin, state = begin[live], child[live].astype(np.int64)
            length += 1
            hit = self.value[state] >= 0
            found.append((begin[hit], begin[hit] + length, self.value[state[hit]].astype(np.int64)))
            more = begin + length < ends[begin]
            begin, state = begin[more], state[more]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


class Lattice:
    """Segmentations of strings laid end to end in buf: string k has bytes bounds[k] to bounds[k + 1].

    Node i + k stands before byte i of string k; each string has one more node behind its last byte.
    """

    def __init__(self, trie: DoubleArray, buf: np.ndarray, bounds: np.ndarray, unknown: int | None = None):
        n = len(bounds) - 1
        length = np.diff(bounds)
        self.owner = np.repeat(np.arange(n), length)
        first, end, piece = _edges(trie, buf, np.repeat(bounds[1:], length), unknown)
        k = self.owner[first] if len(first) else first
        self.first_byte, self.end_byte = first, end
        self.source, self.target, self.piece = first + k, end + k, piece
        self.heads, self.tails = bounds[:-1] + np.arange(n), bounds[1:] + np.arange(n)
        self.nodes = len(buf) + n
        self.forward_order = self._levels(end - bounds[k], self.target)
        self._backward_keys = (bounds[k + 1] - first, self.source)

    @staticmethod
    def _levels(level: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges in order of level, then node, then as they stand; where each level begins."""
        n, high = len(node), int(node.max(initial=0)) + 1
        bits = n.bit_length()
        if ((int(level.max(initial=0)) + 1) * high) << bits < 1 << 63:
            # One number an edge: sorting numbers is much faster than finding an order.
            order = np.sort((level * high + node) << bits | np.arange(n)) & ((1 << bits) - 1)
        else:
            order = np.lexsort((node, level))
        return order, np.append(np.flatnonzero(np.diff(level[order], prepend=-1)), n)

    @staticmethod
    def _walk(out: np.ndarray, known: np.ndarray, now: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> None:
        """Level by level, log of the sum of exp over the edges of each node ``now``, which are of one level and stand side by
        side, of ``known`` nodes' values and the edges' weights."""
        at = np.flatnonzero(np.diff(now, prepend=-1))
        count, nodes, runs = np.diff(np.append(at, len(now))), now[at], np.searchsorted(at, bounds)
        with np.errstate(divide="ignore"):
            for low, high, first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), runs[:-1].tolist(), runs[1:].tolist()):
                values, begin = out[known[low:high]] + weight[low:high], at[first:last] - low
                top = np.maximum.reduceat(values, begin)
                base = np.where(np.isfinite(top), top, 0.0)
                values -= np.repeat(base, count[first:last])
                out[nodes[first:last]] = base + np.log(np.add.reduceat(np.exp(values, out=values), begin))

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """For each node, log of the weight of all segmentations before it."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.heads] = 0.0
        order, bounds = self.forward_order
        self._walk(alpha, self.source[order], self.target[order], scores[self.piece[order]], bounds)
        return alpha

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """log of the weight of all segmentations of each string."""
        return self.forward(scores)[self.tails]

    def number(self, n: int, kinds: np.ndarray) -> None:
        """Numbers pieces by class (one a string) and by whether they are their string's last: n pieces of each sort."""
        k = self.owner[self.first_byte]
        self.piece = self.piece + n * (self.target == self.tails[k]) + 2 * n * kinds[k]

    def spelled(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the best segmentations with their first bytes and ends, and the bounds of the strings."""
        edge, cuts = self.best(scores)
        return self.piece[edge], self.first_byte[edge], self.end_byte[edge], cuts

    def expected(self, scores: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected, string k occurring times[k] times."""
        alpha = self.forward(scores)
        beta = np.full(self.nodes, -np.inf)
        beta[self.tails] = 0.0
        order, bounds = self._levels(*self._backward_keys)
        weight = scores[self.piece]
        self._walk(beta, self.target[order], self.source[order], weight[order], bounds)
        k = self.owner[self.first_byte]
        share = np.exp(alpha[self.source] + weight + beta[self.target] - alpha[self.tails][k]) * times[k]
        return np.bincount(self.piece, share, minlength=len(scores))

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the best segmentation of each string, in order, and their bounds; ties go to the longer last piece."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.heads] = 0.0
        back = np.full(self.nodes, -1, np.int64)
        order, bounds = self.forward_order
        weight = scores[self.piece]
        for low, high in zip(bounds[:-1], bounds[1:]):
            e = order[low:high]
            value, node = alpha[self.source[e]] + weight[e], self.target[e]
            at = np.flatnonzero(np.diff(node, prepend=-1))
            top = np.maximum.reduceat(value, at)
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(node))))
            # Of equals, the smallest source is the longest piece.
            rank = np.where(value == top[group], self.source[e], np.iinfo(np.int64).max)
            chosen = np.minimum.reduceat(rank, at)
            pick = np.flatnonzero((self.source[e] == chosen[group]) & (value == top[group]))
            alpha[node[pick]], back[node[pick]] = value[pick], e[pick]
        steps, strings, at = [], [], self.tails.copy()
        k = np.flatnonzero(at > self.heads)
        while len(k):
            edge = back[at[k]]
            steps.append(edge)
            strings.append(k)
            at[k] = self.source[edge]
            k = k[at[k] > self.heads[k]]
        n = len(self.heads)
        if not steps:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        edge, owner = np.concatenate(steps[::-1]), np.concatenate(strings[::-1])
        edge = edge[np.argsort(owner, kind="stable")]
        return edge, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _edges(trie: DoubleArray, buf: np.ndarray, ends: np.ndarray, unknown: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and id of all pieces; a character that is none gets an edge ``unknown``, if that is given."""
    first, end, piece = trie.edges(buf, ends)
    if unknown is not None and len(buf):
        starts = np.flatnonzero((buf & 0xC0) != 0x80)
        after = np.zeros(len(buf), np.int64)
        after[starts] = np.append(starts[1:], len(buf))
        single = np.zeros(len(buf), bool)
        single[first[end == after[first]]] = True
        lost = starts[~single[starts]]
        first, end = np.concatenate([first, lost]), np.concatenate([end, after[lost]])
        piece = np.concatenate([piece, np.full(len(lost), unknown)])
    return first, end, piece


class LongString:
    """The lattice of one long string, for the same questions: edges are made stretch by stretch and walked one by one,
    so that time grows with the edges and nothing but a number a byte is held of the whole string."""

    def __init__(self, trie: DoubleArray, buf: np.ndarray, unknown: int | None = None):
        self.trie, self.buf, self.unknown = trie, buf, unknown
        self.n, self.kind = 0, 0

    def number(self, n: int, kinds: np.ndarray) -> None:
        self.n, self.kind = n, int(kinds[0])

    def _stretches(self, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First byte, end and numbered piece of the edges that begin in each stretch, by first byte (falling: back)."""
        size = len(self.buf)
        lows = range(0, size, STRETCH)
        for low in reversed(lows) if back else lows:
            part = self.buf[low : low + STRETCH + self.trie.longest + 4]
            first, end, piece = _edges(self.trie, part, np.full(len(part), len(part)), self.unknown)
            own = first < STRETCH
            first, end, piece = first[own] + low, end[own] + low, piece[own]
            if self.n:
                piece = piece + self.n * (end == size) + 2 * self.n * self.kind
            order = np.argsort(-first if back else first, kind="stable")
            yield first[order], end[order], piece[order]

    def _weights(self, scores: np.ndarray, back: bool) -> list[float]:
        """Log of the weight of all segmentations before each node, or behind it."""
        size, none = len(self.buf), float("-inf")
        node = [none] * (size + 1)
        node[size if back else 0] = 0.0
        for first, end, piece in self._stretches(back):
            ways = zip(end.tolist(), first.tolist(), scores[piece].tolist()) if back else zip(first.tolist(), end.tolist(), scores[piece].tolist())
            for known, now, weight in ways:
                one, two = node[known] + weight, node[now]
                if one > two:
                    one, two = two, one
                if two != none:
                    node[now] = two + log1p(exp(one - two))
        return node

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        return np.array([self._weights(scores, False)[-1]])

    def expected(self, scores: np.ndarray, times: np.ndarray) -> np.ndarray:
        alpha, beta = (np.array(self._weights(scores, back)) for back in (False, True))
        out = np.zeros(len(scores))
        for first, end, piece in self._stretches():
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[first] + scores[piece] + beta[end] - alpha[-1])
            out += np.bincount(piece, np.nan_to_num(share) * times[0], minlength=len(scores))
        return out

    def spelled(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, none = len(self.buf), float("-inf")
        node, source, through = [none] * (size + 1), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        node[0] = 0.0
        for first, end, piece in self._stretches():
            # Sources rise, so of equals the first one met is the longest piece.
            for a, b, p, weight in zip(first.tolist(), end.tolist(), piece.tolist(), scores[piece].tolist()):
                if node[a] + weight > node[b]:
                    node[b], source[b], through[b] = node[a] + weight, a, p
        ends, at = [], size
        while at > 0:
            ends.append(at)
            at = int(source[at])
        end = np.array(ends[::-1], np.int64)
        return through[end], source[end], end, np.array([0, len(end)])


def lattice_of(trie: DoubleArray, buf: np.ndarray, bounds: np.ndarray, unknown: int | None = None) -> Lattice | LongString:
    """The lattice of a run of strings that ``blocks`` gave."""
    return LongString(trie, buf, unknown) if len(bounds) == 2 and len(buf) > LONE else Lattice(trie, buf, bounds, unknown)


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The spans laid end to end and their bounds, each behind the byte ``head`` if one is given."""
    extra = head is not None
    length = ends - starts + extra
    bounds = np.concatenate([[0], np.cumsum(length)])
    index = np.repeat(starts - bounds[:-1] - extra, length) + np.arange(bounds[-1])
    if not extra:
        return buf[index], bounds
    out = buf[np.maximum(index, 0)] if len(buf) else np.zeros(bounds[-1], np.uint8)
    out[bounds[:-1]] = head
    return out, bounds


def blocks(bounds: np.ndarray, limit: int = BLOCK):
    """Runs of strings of at most so many bytes; a string of more than LONE bytes is a run by itself, so that how it is
    walked depends on it alone."""
    low, n = 0, len(bounds) - 1
    lone = np.append(np.flatnonzero(np.diff(bounds) > LONE), n)
    while low < n:
        stop = int(lone[np.searchsorted(lone, low)])
        high = low + 1 if stop == low else min(stop, max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1))
        yield low, high
        low = high

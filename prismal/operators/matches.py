"""Matches over a sliding window: texts as literals and copies (length, distance), and back.

A place where a token begins is tried with the nearest earlier places that begin with the same three symbols, up to `chain` of them within `window`. How
far two places agree is found by hashes of powers of two, for a place of every text of a batch at once; the copies that a
greedy parse takes are then compared symbol by symbol. A long text is cut into segments of `SEGMENT` symbols, each with the window before it,
so memory is bounded; a copy ends with its segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, WINDOW, CHAIN = 3, 1 << 15, 16
SEGMENT = 1 << 17
#: Powers of two up to which agreement is measured at once.
DOUBLINGS = 9
#: Symbols that a task parses side by side, pieces under which each goes alone, and places that are then looked up ahead.
TOGETHER, FEW, AHEAD = 1 << 22, 16, 512
MIX = np.uint64(0x9E3779B97F4A7C15)
TOKENS = "key long, at long, symbol int, length int, distance int"


class _Pieces:
    """Segments of texts, each after the window before it, in one array; matches are looked up where a parse asks for them."""

    def __init__(self, pieces: list[np.ndarray]) -> None:
        size = np.array([len(p) for p in pieces], "i8")
        self.s, self.ends = np.concatenate(pieces), np.cumsum(size)
        self.begins = self.ends - size
        used = np.zeros(int(self.s.max()) + 1, bool)
        used[self.s] = True
        sym, m = (np.cumsum(used) - 1)[self.s], int(used.sum())
        grams = (sym[:-2] * m + sym[1:-1]) * m + sym[2:]
        # places of a piece that begin with the same three symbols stand together, in order: those before one are its candidates
        order, first = [], []
        for begin, end in zip(self.begins.tolist(), (self.ends - LEAST + 1).tolist(), strict=True):
            if end > begin:
                own = np.argsort(grams[begin:end], kind="stable")
                same = grams[begin:end][own]
                fresh = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
                held = sum(map(len, order[-1:])) + (first[-1][0] if first else 0)
                order.append(own + begin)
                first.append((held, np.repeat(fresh, np.diff(fresh, append=len(own)))))
        self.order = np.concatenate([np.zeros(0, "i8"), *order])
        group = np.concatenate([np.zeros(0, "i8"), *(at + f for at, f in first)])
        self.rank, self.tried = np.zeros(len(self.s), "i8"), np.zeros(len(self.s), "i8")
        self.rank[self.order] = np.arange(len(self.order))
        self.tried[self.order] = np.arange(len(self.order)) - group
        wide = self.s.astype("u8")
        self.hashes = [wide * MIX ^ (wide >> np.uint64(7))]
        for k in range(1, DOUBLINGS + 1):
            h, half = self.hashes[-1], 1 << (k - 1)
            self.hashes.append(((h[:-half] ^ (h[:-half] >> np.uint64(29))) * MIX + h[half:]) if len(h) > half else h[:0])

    def longest(self, i: np.ndarray, ends: np.ndarray, window: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place: length (up to `ends`) and distance of the longest match that was tried, the nearest of equals; 0 for none."""
        length, distance = np.zeros(len(i), "i8"), np.zeros(len(i), "i8")
        count = np.minimum(self.tried[i], chain)
        of = np.repeat(np.arange(len(i)), count)
        back = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(count) - count, count)
        a = i[of]
        b = self.order[self.rank[a] - back]
        near = a - b <= window
        if not near.all():
            of, back, a, b = of[near], back[near], a[near], b[near]
        if not len(of):
            return length, distance
        end, agreed = ends[of], np.full(len(of), LEAST, "i8")

        def more(which: np.ndarray, k: int) -> np.ndarray:
            """Whether 2^k further symbols agree; they are then counted."""
            x, y = a[which] + agreed[which], b[which] + agreed[which]
            fits = x + (1 << k) <= end[which]
            fits[fits] = self.hashes[k][x[fits]] == self.hashes[k][y[fits]]
            agreed[which[fits]] += 1 << k
            return fits

        alive, k, short = np.arange(len(of)), 0, np.zeros(len(of), "i1")
        while len(alive):  # twice as many each time
            on = more(alive, k)
            short[alive[~on]] = k
            alive, k = alive[on], min(k + 1, DOUBLINGS)
        for k in range(int(short.max()) - 1, -1, -1):  # what is left is under 2^short
            more(np.flatnonzero(short > k), k)
        score = agreed * (chain + 1) - back
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.repeat(np.maximum.reduceat(score, starts), np.diff(starts, append=len(of)))
        at = np.flatnonzero(score == most)
        length[of[at]], distance[of[at]] = agreed[at], (a - b)[at]
        copied = np.repeat(np.arange(len(i)), length)
        place = i[copied] + np.arange(len(copied)) - np.repeat(np.cumsum(length) - length, length)
        if (wrong := self.s[place] != self.s[place - distance[copied]]).any():  # equal hashes of unequal symbols
            np.minimum.at(length, copied[wrong], (place - i[copied])[wrong])
        return length, distance


def _parsed(pieces: list[np.ndarray], starts: list[int], window: int, chain: int) -> tuple[np.ndarray, ...]:
    """piece, place in it, symbol, length, distance of the tokens of pieces from their starts on. A step takes a token of every piece; the FEW longest are then looked up ahead."""
    held = _Pieces(pieces)
    at, out = held.begins + np.array(starts), []

    def put(piece: np.ndarray, i: np.ndarray, length: np.ndarray, distance: np.ndarray) -> None:
        out.append((piece, i - held.begins[piece], np.where(length, 0, held.s[i]), length, np.where(length, distance, 0)))

    while len(live := np.flatnonzero(at < held.ends)) > FEW:
        length, distance = held.longest(at[live], held.ends[live], window, chain)
        put(live, at[live], length, distance)
        at[live] += np.maximum(length, 1)
    for piece in live.tolist():
        now, end = int(at[piece]), int(held.ends[piece])
        while now < end:
            ahead = np.arange(now, min(end, now + AHEAD))
            length, distance = held.longest(ahead, np.full(len(ahead), end), window, chain)
            steps, taken, k = np.maximum(length, 1).tolist(), [], 0
            while k < len(steps):
                taken.append(k)
                k += steps[k]
            put(np.full(len(taken), piece), ahead[taken], length[taken], distance[taken])
            now += k
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _segments(symbols: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Segment with the window before it, where it starts in that, and place of the first of these symbols in the text."""
    for begin in range(0, len(symbols), SEGMENT):
        before = max(0, begin - window)
        yield symbols[before : begin + SEGMENT], begin - before, before


def parsed(symbols: np.ndarray, window: int = WINDOW, chain: int = CHAIN) -> Iterator[tuple[int, int, int, int]]:
    """(place, symbol, length, distance) of the tokens of a text: a literal has length 0, a copy symbol 0."""
    for piece, start, before in _segments(symbols, window):
        _, at, *rest = _parsed([piece], [start], window, chain)
        yield from zip((at + before).tolist(), *(c.tolist() for c in rest), strict=True)


def _tokens(batches: Iterator[pa.RecordBatch], window: int, chain: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TOKENS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def done() -> Iterator[pa.RecordBatch]:
        piece, at, *rest = _parsed([p[0] for p in pieces], [p[1] for p in pieces], window, chain)
        found = [pa.array(keys, pa.int64()).take(pa.array(piece)), at + np.array([p[2] for p in pieces])[piece], *rest]
        whole = pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip([found[0], *(c.astype(t.to_pandas_dtype()) for c, t in zip(found[1:], kinds[1:], strict=True))], kinds, strict=True)], names)
        for begin in range(0, len(whole), 1 << 16):
            yield whole.slice(begin, 1 << 16)

    keys, pieces, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for segment in _segments(np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4"), window):
                keys.append(key)
                pieces.append(segment)
                size += len(segment[0])
                if size >= TOGETHER:
                    yield from done()
                    keys, pieces, size = [], [], 0
    if pieces:
        yield from done()


def tokens(df: DataFrame, key: str, text: str, window: int = WINDOW, chain: int = CHAIN) -> DataFrame:
    """key, at, symbol, length, distance of every token of the texts; symbols are code points. A text without symbols has none."""
    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(partial(_tokens, window=window, chain=chain), TOKENS)


def expanded(symbols: list[int], lengths: list[int], distances: list[int]) -> str:
    """The text of tokens in order; a copy may overlap what it makes. Each symbol points to where it is copied from, and pointers are followed twice as far each time."""
    size = np.maximum(np.asarray(lengths, "i8"), 1)
    total = int(size.sum())
    source = np.arange(total) - np.repeat(np.asarray(distances, "i8"), size)
    values = np.repeat(np.asarray(symbols, "<u4"), size)
    while not np.array_equal(further := source[source], source):
        source = further
    return values[source].tobytes().decode("utf-32-le")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a text in order, text after text: those of a batch together, the last one when it is whole."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        key, fresh = rows["key"].combine_chunks(), begins(rows)
        columns = [rows[c].to_numpy() for c in names[2:]]
        size = np.maximum(columns[1].astype("i8"), 1)
        whole = expanded(*columns)
        cuts = [*(np.cumsum(size) - size)[fresh].tolist(), len(whole)]
        return pa.RecordBatch.from_arrays([key.take(pa.array(fresh)), pa.array([whole[a:b] for a, b in pairwise(cuts)], pa.string())], ["key", "text"])

    def begins(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Rows with which a text begins: a first place, or another key than before."""
        key = rows["key"].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["key"].to_numpy()
        fresh = rows["at"].to_numpy() == 0
        fresh[1:] |= (key[1:] != key[:-1]) & ((key[1:] == key[1:]) | (key[:-1] == key[:-1]))  # none is not a number here
        fresh[:1] = True
        return np.flatnonzero(fresh)

    for b in batches:
        if not b.num_rows:
            continue
        cut = int(begins(b)[-1])
        if cut == 0 and held and b["at"][0].as_py() and b["key"][0] == held[-1]["key"][0]:
            held.append(b)
            continue
        if held or cut:
            yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield done(pa.Table.from_batches(held))


def texts(found: DataFrame, together: bool = False) -> DataFrame:
    """key, text of tokens(). together: the tokens of a text still follow each other, as tokens() gives them, and needn't be dealt."""
    dealt = found if together else found.repartition("key").sortWithinPartitions("key", "at")
    return dealt.mapInArrow(_texts, "key long, text string")

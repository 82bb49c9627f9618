"""Symbol streams, histograms, entropy and code construction."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.scalar import ceil_log2


#: Characters of texts that a task holds at once (a longer text alone), and those of a piece of a text whose list of symbols is kept on its own.
HELD, PIECE = 1 << 23, 256
#: Streams under which each is coded symbol by symbol.
FEW = 24


def of_text(df: DataFrame, key: str, context: str, text: str) -> DataFrame:
    """(key, ctx, pos, sym): the characters of a text as code points."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return df.select(F.col(key).alias("key"), F.col(context).alias("ctx"), F.posexplode(chars).alias("pos", "c")).select("key", "ctx", F.col("pos").cast("long").alias("pos"), F.ascii("c").cast("long").alias("sym"))


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of texts with characters, about `size` of these at a time: what stands before each text, their lengths, and all code points in turn."""
    names, texts, total = [], [], 0
    pack = lambda: (names, np.array([len(t) for t in texts], "i8"), np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"))
    for b in batches:
        for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if text := text.as_py():
                names.append(name)
                texts.append(text)
                total += len(text)
                if total >= size:
                    yield pack()
                    names, texts, total = [], [], 0
    if names:
        yield pack()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, length, s in _held(batches, 1 << 21):
        known = {n: k for k, n in enumerate(dict.fromkeys(names))}
        used, ids = _alphabet(s)
        n = np.bincount(np.repeat(np.array([known[x] for x in names]), length) * len(used) + ids, minlength=len(known) * len(used))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(at // len(used))), pa.array(used[at % len(used)].astype("i8")), pa.array(n[at])], ["ctx", "sym", "n"])


def text_histogram(df: DataFrame, context: str, text: str) -> DataFrame:
    """histogram() of of_text(): characters are counted inside tasks, and only counts are dealt."""
    found = df.select(F.col(context).cast("string"), F.col(text).cast("string")).mapInArrow(_counts, "ctx string, sym long, n long")
    return found.groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def _alphabet(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in order, and the place of each symbol among them."""
    on = np.zeros(int(s.max()) + 1, bool)
    on[s] = True
    used = np.nonzero(on)[0]
    place = np.zeros(len(on), "i8")
    place[used] = np.arange(len(used))
    return used, place[s]


def text_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of equal characters, found inside each text: key, start, sym, length, and the cost class of the length."""
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  value is worked out once
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    edges = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, F.greatest(i - 1, F.lit(0)))))
    run = lambda c, starts: F.transform(starts, lambda at, k: F.struct(at.alias("start"), F.ascii(F.get(c, at)).alias("sym"), (F.coalesce(F.get(starts, k + 1), F.size(c)) - at).alias("length")))
    found = bind(chars, lambda c: bind(edges(c), lambda starts: run(c, starts)))
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("key"), F.explode(found).alias("r"))
    return rows.select("key", F.col("r.start").cast("long").alias("start"), F.col("r.sym").cast("long").alias("sym"), F.col("r.length").cast("long").alias("length"), ceil_log2(F.col("r.length")).cast("long").alias("cost"))


def histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("ctx", "sym").agg(F.count("*").alias("n"))


def entropy(hist: DataFrame) -> DataFrame:
    """Bits that each context's symbols cost under their own distribution."""
    found = hist.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return found.select("ctx", "total", F.round(F.col("total") * F.log2("total") - F.col("own"), 4).alias("bits"))


def alphabet(hist: DataFrame) -> DataFrame:
    return hist.groupBy("ctx").agg((F.max("sym") + 1).alias("size"), F.count("*").alias("used"))


def _bits(n: Column, total: Column) -> Column:
    return F.when(n > 0, n * F.log2(total / n)).otherwise(0.0)


def pairs(hist: DataFrame) -> DataFrame:
    """a, b, na, nb, ta, tb for every pair of contexts and symbol that either has."""
    total = hist.groupBy("ctx").agg(F.sum("n").alias("t"))
    both = total.alias("a").join(total.alias("b"), F.col("a.ctx") < F.col("b.ctx")).select(F.col("a.ctx").alias("a"), F.col("b.ctx").alias("b"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb"))
    left = both.join(hist, hist["ctx"] == both["a"]).select("a", "b", "ta", "tb", "sym", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"))
    right = both.join(hist, hist["ctx"] == both["b"]).select("a", "b", "ta", "tb", "sym", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))
    return left.union(right).groupBy("a", "b", "ta", "tb", "sym").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def merge_distance(hist: DataFrame) -> DataFrame:
    """Bits lost by coding two contexts with one distribution."""
    n, t = F.col("na") + F.col("nb"), F.col("ta") + F.col("tb")
    return pairs(hist).groupBy("a", "b").agg(F.round(F.sum(_bits(n, t) - _bits(F.col("na"), F.col("ta")) - _bits(F.col("nb"), F.col("tb"))), 3).alias("distance"))


def kl(hist: DataFrame) -> DataFrame:
    """Bits lost by coding a with the distribution of b; infinite where b lacks a symbol of a."""
    own = _bits(F.col("na"), F.col("ta"))
    cross = F.when(F.col("na") == 0, 0.0).when(F.col("nb") == 0, F.lit(float("inf"))).otherwise(F.col("na") * F.log2(F.col("tb") / F.col("nb")))
    return pairs(hist).groupBy("a", "b").agg(F.sum(cross - own).alias("d")).select("a", "b", (F.col("d") == float("inf")).alias("infinite"), F.when(F.col("d") == float("inf"), -1.0).otherwise(F.round("d", 3)).alias("kl"))


def runs(symbols: DataFrame) -> DataFrame:
    """Runs of equal symbols in a stream (gaps and islands): key, start, sym, length, and the cost class of the length."""
    w = Window.partitionBy("key").orderBy("pos")
    edge = symbols.withColumn("new", F.when(F.lag("sym").over(w) == F.col("sym"), 0).otherwise(1))
    island = edge.withColumn("run", F.sum("new").over(w))
    return island.groupBy("key", "run").agg(F.min("pos").alias("start"), F.min("sym").alias("sym"), F.count("*").alias("length")).select("key", "start", "sym", "length", ceil_log2(F.col("length")).cast("long").alias("cost"))


def move_to_front(symbols: DataFrame) -> DataFrame:
    """Index of a symbol in a list that moves each used one to its front: distinct symbols since its last use (first use: -1).

    A pass over the stream of a key with the list as its state; a task holds one key's stream.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        front: list[int] = []
        seen: set[int] = set()
        out = []
        for s in pdf["sym"].tolist():
            if s in seen:
                at = front.index(s)
                del front[at]
            else:
                at = -1
                seen.add(s)
            front.insert(0, s)
            out.append(at)
        return pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "index": np.array(out, "i8")})

    return symbols.select("key", "pos", "sym").groupBy("key").applyInPandas(run, "key long, pos long, index long")


def _front_list(ids: list[int]) -> list[int]:
    """move_to_front() of one stream, symbol by symbol."""
    front: list[int] = []
    seen: set[int] = set()
    out = []
    for s in ids:
        if s in seen:
            at = front.index(s)
            del front[at]
        else:
            at = -1
            seen.add(s)
        front.insert(0, s)
        out.append(at)
    return out


def _front_pieces(ids: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """move_to_front() of streams that follow each other, of at most 256 symbols: a step takes the next symbol of every piece of every stream.

    A piece begins with the list that the pieces before it leave: symbols by their last use, and then those not used.
    """
    ends = np.cumsum(length)
    count = -(-length // PIECE)
    stream = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(stream)) - np.repeat(np.cumsum(count) - count, count)
    begin = (ends - length)[stream] + k * PIECE
    own = np.minimum(PIECE, ends[stream] - begin)
    last = np.full((len(stream) + 1, size), -1, "i8")
    last[np.repeat(np.arange(len(stream)), own) + 1, ids] = np.arange(len(ids))  # the last of equal places stays
    last = np.maximum.accumulate(last, axis=0)[:-1]
    last[last < (ends - length)[stream][:, None]] = -1
    used = (last >= 0).sum(1)
    rank = np.empty(last.shape, "u1")
    np.put_along_axis(rank, np.argsort(-last, axis=1, kind="stable"), np.arange(size, dtype="u1")[None, :], axis=1)
    order = np.argsort(-own, kind="stable")
    rank, used, begin, own = rank[order], used[order], begin[order], own[order]
    out = np.empty(len(ids), "i8")
    at = np.arange(len(order))
    for step in range(int(own[0])):
        n = int(np.searchsorted(-own, -step, "left"))  # pieces longer than step
        place = begin[:n] + step
        sym, lists = ids[place], rank[:n]
        r = lists[at[:n], sym]
        new = r >= used[:n]
        out[place] = r
        out[place[new]] = -1
        used[:n] += new
        np.add(lists, (lists < r[:, None]).view("u1"), out=lists)
        lists[at[:n], sym] = 0
    return out


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, length, s in _held(batches, 1 << 20):
        used, ids = _alphabet(s)
        if len(used) <= 256:
            index = _front_pieces(ids, length, len(used))
        else:
            index = np.empty(len(s), "i8")
            for end, n in zip(np.cumsum(length).tolist(), length.tolist(), strict=True):
                used, ids = _alphabet(s[end - n : end])
                index[end - n : end] = _front_pieces(ids, np.array([n]), len(used)) if len(used) <= 256 and n > PIECE * PIECE else _front_list(ids.tolist())
        pos = np.arange(len(s)) - np.repeat(np.cumsum(length) - length, length)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()).take(pa.array(np.repeat(np.arange(len(length)), length))), pa.array(pos), pa.array(index)], ["key", "pos", "index"])


def move_to_front_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, index: move_to_front() over the characters of each text, in the task that reads it; no row is dealt."""
    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_fronts, "key long, pos long, index long")


def reindex(df: DataFrame, label: str, order: str) -> DataFrame:
    """Labels renumbered by first appearance. The window is over one row per label."""
    first = df.groupBy(label).agg(F.min(order).alias("first"))
    return first.select(F.col(label).alias("label"), "first", (F.row_number().over(Window.orderBy("first", label)) - 1).cast("long").alias("id"))


def lengths_limited(counts: list[int], limit: int) -> list[int]:
    """Code lengths of a Huffman code; counts are raised to a floor that doubles until no code is over the limit."""
    floor = 1
    while True:
        heap = [(max(c, floor), k, (k,)) for k, c in enumerate(counts) if c]
        depth = [0] * len(counts)
        if len(heap) == 1:
            depth[heap[0][1]] = 1
            return depth
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                depth[k] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if not heap or max(depth) <= limit:
            return depth
        floor *= 2


def huffman(hist: DataFrame, limit: int = 15) -> DataFrame:
    """ctx, sym, n, length and canonical rank of a length-limited code. A task holds one context's alphabet."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sym")
        pdf["length"] = lengths_limited([int(x) for x in pdf["n"]], limit)
        return pdf[["ctx", "sym", "n", "length"]]

    rank = F.row_number().over(Window.partitionBy("ctx").orderBy("length", "sym")) - 1
    return hist.groupBy("ctx").applyInPandas(build, "ctx string, sym long, n long, length long").withColumn("rank", rank.cast("long"))


def normalized(counts: np.ndarray, total: int = 4096) -> np.ndarray:
    """Counts scaled to a table that sums to total, each used symbol at least 1; the largest takes the rounding."""
    out = np.where(counts > 0, np.maximum(1, counts * total // max(1, counts.sum())), 0)
    while out.sum() != total:
        k = int(out.argmax())
        out[k] += min(total - out.sum(), total) if out.sum() < total else -min(out.sum() - total, out[k] - 1)
    return out


def _ans_sizes(freq: np.ndarray) -> tuple[int, int, int]:
    """Bits of the table, bits of the least state, first state."""
    bits = int(freq.sum()).bit_length() - 1
    low = max(16, bits)
    return bits, low, 0x130000 << (low - 16)


def ans_encode(symbols: list[int], freq: np.ndarray) -> tuple[int, list[int]]:
    """rANS with a table of a power of two (12 bits unless the alphabet is larger) and 16-bit renormalisation, last symbol first: final state and words."""
    return _ans_put(symbols, freq, _ans_sizes(freq)[2])


def _ans_put(symbols: list[int], freq: np.ndarray, state: int) -> tuple[int, list[int]]:
    """State and further words once symbols, last first, are put on a state."""
    bits, low, _ = _ans_sizes(freq)
    start, freq, words = np.concatenate([[0], np.cumsum(freq)]).tolist(), freq.tolist(), []
    for s in reversed(symbols):
        f = freq[s]
        while state >= f << (low + 16 - bits):
            words.append(state & 0xFFFF)
            state >>= 16
        state = (state // f << bits) + start[s] + state % f
    return state, words


def ans_decode(state: int, words: list[int], n: int, freq: np.ndarray) -> tuple[list[int], int]:
    bits, low, _ = _ans_sizes(freq)
    start = np.concatenate([[0], np.cumsum(freq)]).tolist()
    of = np.repeat(np.arange(len(freq)), freq).tolist()
    freq, mask, out, words = freq.tolist(), (1 << bits) - 1, [], list(words)
    for _ in range(n):
        slot = state & mask
        s = of[slot]
        out.append(s)
        state = freq[s] * (state >> bits) + slot - start[s]
        while state < 1 << low:
            state = state << 16 | words.pop()
    return out, state


def ans_round_trip(symbols: DataFrame) -> DataFrame:
    """Per key: symbols, 16-bit words of its rANS stream, whether decoding gives the symbols and the initial state back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("pos")["sym"].to_numpy()
        names, ids = np.unique(s, return_inverse=True)
        freq = normalized(np.bincount(ids), 1 << max(12, len(names).bit_length()))
        state, words = ans_encode(ids.tolist(), freq)
        back, last = ans_decode(state, words, len(ids), freq)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(s)], "alphabet": [len(names)], "words": [len(words)], "exact": [back == ids.tolist() and last == _ans_sizes(freq)[2]]})

    return symbols.groupBy("key").applyInPandas(run, "key long, n long, alphabet long, words long, exact boolean")


def _ans_streams(ids: np.ndarray, length: np.ndarray, freqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each stream, and whether it comes back: ans_encode() and ans_decode() of streams that follow each other, longest first, all with tables of 12 bits.

    A step takes one symbol of every stream that has it; what the FEW longest have beyond the others goes symbol by symbol.
    """
    bits, low, first = _ans_sizes(freqs[0])
    begin = np.cumsum(length) - length
    table = np.cumsum([0, *(len(f) for f in freqs)])[:-1].astype("i4")
    freq, start = np.concatenate(freqs).astype("i8"), np.concatenate([np.cumsum(f) - f for f in freqs]).astype("i8")
    of = np.repeat(np.arange(len(freq), dtype="i4"), freq)
    slots = np.arange(len(length)) << bits
    state = np.full(len(length), first, "i8")
    words, room = np.empty(len(ids), "u2"), begin  # a symbol gives a word at most
    held = room.copy()
    together = int(length[FEW]) if len(length) > FEW else 0
    alone = range(int(np.searchsorted(-length, -together, "left")))
    width = np.searchsorted(-length, -np.arange(together), "left")
    ends = np.cumsum(width)
    stream = np.arange(ends[-1] if together else 0, dtype="i4") - np.repeat((ends - width).astype("i4"), width)
    turned = table[stream] + ids[begin[stream] + np.repeat(np.arange(together, dtype="i4"), width)].astype("i4")  # by step, then by stream
    for k in alone:
        last, more = _ans_put(ids[begin[k] + together : begin[k] + length[k]].tolist(), freqs[k], first)
        words[held[k] : held[k] + len(more)] = more
        held[k] += len(more)
        state[k] = last
    for n, end in zip(width[::-1].tolist(), ends[::-1].tolist(), strict=True):
        c = turned[end - n : end]
        f, x = freq[c], state[:n]
        full = np.flatnonzero(x >= f << (low + 16 - bits))
        if len(full):
            over, at = x[full], held[full]
            words[at] = over & 0xFFFF
            held[full] = at + 1
            x[full] = over >> 16
        q = x // f
        state[:n] = x + start[c] + q * ((1 << bits) - f)  # q << bits, and the remainder
    found, same = held - room, np.ones(len(length), bool)
    for n, end in zip(width.tolist(), ends.tolist(), strict=True):
        x = state[:n]
        slot = x & ((1 << bits) - 1)
        c = of[slots[:n] + slot]
        same[:n] &= c == turned[end - n : end]
        x = freq[c] * (x >> bits) + slot - start[c]
        short = np.flatnonzero(x < 1 << low)
        if len(short):
            at = held[short] - 1
            held[short] = at
            x[short] = x[short] << 16 | words[at]
        state[:n] = x
    for k in alone:
        own = ids[begin[k] + together : begin[k] + length[k]].tolist()
        back, state[k] = ans_decode(int(state[k]), words[room[k] : held[k]].tolist(), len(own), freqs[k]) if same[k] else ([], 0)
        held[k] = room[k]
        same[k] &= back == own
    return found, same & (state == first) & (held == room)


def _ans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, length, s in _held(batches, HELD):
        ends = np.cumsum(length).tolist()
        order = np.argsort(-length, kind="stable").tolist()
        parts = [_alphabet(s[ends[k] - length[k] : ends[k]])[1] for k in order]
        freqs = [normalized(c := np.bincount(p), 1 << max(12, len(c).bit_length())) for p in parts]
        usual = [k for k, f in enumerate(freqs) if len(f) < 1 << 12]
        rows = {}
        if usual:
            words, exact = _ans_streams(np.concatenate([parts[k] for k in usual]), length[order][usual], [freqs[k] for k in usual])
            rows = dict(zip(usual, zip(words.tolist(), exact.tolist(), strict=True), strict=True))
        for k in rows.keys() ^ range(len(parts)):  # larger tables
            state, words = ans_encode(own := parts[k].tolist(), freqs[k])
            back, last = ans_decode(state, words, len(own), freqs[k])
            rows[k] = len(words), back == own and last == _ans_sizes(freqs[k])[2]
        columns = [[names[j] for j in order], [len(p) for p in parts], [len(f) for f in freqs], *zip(*(rows[k] for k in range(len(parts))), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], ["key", "n", "alphabet", "words", "exact"])


def ans_round_trip_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """ans_round_trip() of the characters of each text, in the task that reads it; no row is dealt."""
    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_ans, "key long, n long, alphabet long, words long, exact boolean")


def lehmer(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Lehmer digits of a permutation: later elements that are smaller. In each group's array; groups are small (a frame's sections)."""
    line = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("s"))
    digits = F.transform("s", lambda x, i: F.size(F.filter("s", lambda z: (z["o"] > x["o"]) & (z["v"] < x["v"]))))
    return line.select(group, F.posexplode(digits).alias("pos", "digit"))

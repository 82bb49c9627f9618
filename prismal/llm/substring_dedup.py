"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `size` bytes, most significant digit first; suffixes that are still equal
after the last digit start one repeated window. A digit is a long run of bytes by its 64-bit hash: equality of
windows is all that is asked, not their alphabetical order.

First digit: every window of `size` bytes is filed under its anchor, the least `GRAM`-byte string in it (by hash,
leftmost on ties); equal windows have equal anchors at equal distances. Anchors with all the windows they stand for are one
row, a few per `size` bytes, and only those whose digit occurs again are kept. Rows whose whole
context (all bytes of all their windows) is equal are equal at full depth at once; only contexts that differ under one anchor
are fetched and sorted through the remaining digits, window by window. Contexts under one anchor in over `heavy` versions
are sorted as rows of a table instead of in one task.

Defined results: a null text is empty; texts shorter than `size` lose nothing; repeated rows are repeated texts; windows never
cross documents; an empty table gives no row; other columns are ignored. Texts that are copies of each other are one text with a
count, so they are worked on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import table

GRAM, LIMIT = 32, 1 << 21
BASE = 0x9E3779B97F4A7C15
_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte; powers of the base and of its inverse, modulo 2^64. One set per worker, grown by doubling."""
    if not _TABLES or len(_TABLES[0][1]) < n:
        values = np.random.default_rng(5).integers(0, 1 << 64, 256, "u8")
        powers = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(LIMIT + 1, 1 << (n - 1).bit_length()), base, "u8")
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        _TABLES[:] = [(values, *powers)]
    return _TABLES[0]


class Rolling:
    """Hash of any run of bytes in a buffer, in a few operations for many runs at once."""

    def __init__(self, data: np.ndarray) -> None:
        values, up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i+w] for every i where that fits."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    ahead = np.minimum.accumulate(full.reshape(-1, w), 1).ravel()
    back = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text key, where the segment starts, bytes); long texts in segments that overlap by size - 1."""
    held, total = [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            for at in range(0, len(text) - size + 1, LIMIT // 2):
                part = text[at : at + LIMIT // 2 + size - 1]
                if total + len(part) > LIMIT and held:
                    yield held
                    held, total = [], 0
                held.append((key, at, part))
                total += len(part)
    if held:
        yield held


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    low = np.uint64(LIMIT * 2 - 1)
    seen: set[int] = set()
    for held in _segments(batches, size):
        held = [x for x in held if x[0] not in seen]
        seen |= {x[0] for x in held if len(x[2]) < LIMIT // 2}
        if len(seen) > 500_000:
            seen.clear()
        if not held:
            continue
        data = np.frombuffer(b"".join(x[2] for x in held), "u1")
        roll = Rolling(data)
        sizes = np.array([len(x[2]) for x in held])
        begin = np.cumsum(sizes) - sizes
        grams = roll.of(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
        least = sliding_least((grams & ~low) | np.arange(len(grams), dtype="u8"), size - GRAM + 1)
        starts = np.concatenate([np.arange(b, b + n - size + 1) for b, n in zip(begin, sizes, strict=True)])
        at = (least[starts] & low).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        p0, p1 = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1]
        a = at[first]
        of = np.searchsorted(begin, a, "right") - 1
        shift = np.array([x[1] for x in held])[of] - begin[of]
        ctx = roll.of(p0, p1 + size) + np.uint64(BASE) * (a - p0).astype("u8")
        yield pa.RecordBatch.from_pydict({"anchor": grams[a].view("i8"), "ctx": ctx.view("i8"), "key": np.array([x[0] for x in held], "i8")[of], "at": a + shift, "p0": p0 + shift, "p1": p1 + shift})


def _contexts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "key", "at", "p0", "p1", "single", "heavy", "bytes"]
    for b in batches:
        out: list[tuple] = []
        for text, key, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out += [(w["anchor"], key, w["at"], w["p0"], w["p1"], w["single"], w["heavy"], text[w["p0"] : w["p1"] + size]) for w in wanted]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)


def _windows(rows: list[dict], size: int) -> tuple[np.ndarray, ...]:
    """For every window of the contexts: its row, start, distance to the anchor, and its two remaining digits."""
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), "u1")
    roll = Rolling(data)
    n = np.array([r["p1"] - r["p0"] + 1 for r in rows])
    begin = np.cumsum(n + size - 1) - (n + size - 1)
    of = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = begin[of] + inner
    half = size // 2
    start = np.array([r["p0"] for r in rows])[of] + inner
    away = np.array([r["at"] for r in rows])[of] - start
    return of, start, away, roll.of(p, p + half), roll.of(p + half, p + size)


def _sort(rows: list[dict], size: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of single contexts that are equal to another, by passes over the digits left."""
    of, start, away, *digits = _windows(rows, size)
    _, anchor = np.unique(np.array([r["anchor"] for r in rows]), return_inverse=True)
    group = anchor[of] * 4096 + away
    alive = np.arange(len(of))
    for digit in digits:
        order = np.lexsort((digit[alive], group))
        g, d = group[order], digit[alive][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        name = np.cumsum(new) - 1
        twice = np.bincount(name)[name] > 1 if len(name) else np.zeros(0, bool)
        alive, group = alive[order][twice], name[twice]
        if not len(alive):
            return
    alive = np.sort(alive[np.array([r["single"] for r in rows])[of[alive]]])
    if not len(alive):
        return
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(alive) != 1) | (np.diff(of[alive]) != 0)]))
    last = np.concatenate([cut[1:], [len(alive)]]) - 1
    keys = np.array([r["key"] for r in rows], "i8")
    yield pa.RecordBatch.from_pydict({"key": keys[of[alive[cut]]], "s": start[alive[cut]], "e": start[alive[last]] + size})


def _sorted_spans(batches: Iterator[pa.RecordBatch], size: int, rows_at_once: int = 2500) -> Iterator[pa.RecordBatch]:
    """Input in the order of anchors: whole anchors are sorted together."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if len(held) >= rows_at_once and r["anchor"] != held[-1]["anchor"]:
                yield from _sort(held, size)
                held = []
            held.append(r)
    if held:
        yield from _sort(held, size)


def _exploded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for i in range(0, len(rows), 1000):
            some = rows[i : i + 1000]
            of, start, away, one, two = _windows(some, size)
            mixed = one + np.array([r["anchor"] for r in some], "i8").view("u8")[of] * np.uint64(3) + away.astype("u8")
            yield pa.RecordBatch.from_pydict({"key": np.array([r["key"] for r in some], "i8")[of], "s": start, "single": np.array([r["single"] for r in some])[of], "d1": mixed.view("i8"), "d2": two.view("i8")})


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, copies, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = text or b""
            gone = [(0, len(text))] if copies > 1 and len(text) >= size else merged(spans)
            h, at = hashlib.sha256(), 0
            for s, e in gone:
                h.update(text[at:s])
                at = e
            h.update(text[at:])
            out.append((doc, len(text), sum(e - s for s, e in gone), len(gone), h.hexdigest(), [{"s": s, "e": e} for s, e in gone]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, size: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(key, copies) of every distinct text; (key, spans) of texts that hold repeated windows (of any distinct text)."""
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    found = keyed.filter(F.octet_length("text") >= size).mapInArrow(partial(_anchors, size=size), "anchor long, ctx long, key long, at long, p0 long, p1 long")
    anchors = table(found, "anchors")
    apart = anchors.repartition("anchor").distinct()
    by_ctx = apart.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "p0", "p1")).alias("r"))
    seen = by_ctx.withColumn("versions", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1 or versions > 1")
    grouped = table(seen, "anchor-groups")
    whole = apart.join(grouped.filter("n > 1").select("anchor", "ctx"), ["anchor", "ctx"], "left_semi").select("key", F.col("p0").alias("s"), (F.col("p1") + size).alias("e"))
    asked = grouped.filter("versions > 1").select("r.key", F.struct("anchor", "r.at", "r.p0", "r.p1", (F.col("n") == 1).alias("single"), (F.col("versions") > heavy).alias("heavy")).alias("w"))
    asked = asked.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    one = keyed.join(asked, "key").dropDuplicates(["key"])
    schema = "anchor long, key long, at long, p0 long, p1 long, single boolean, heavy boolean, bytes binary"
    contexts = table(one.select("text", "key", "wanted").mapInArrow(partial(_contexts, size=size), schema), "contexts")
    light = contexts.filter("not heavy").repartition("anchor").sortWithinPartitions("anchor")
    some = light.mapInArrow(partial(_sorted_spans, size=size), "key long, s long, e long")
    rows = contexts.filter("heavy").mapInArrow(partial(_exploded, size=size), "key long, s long, single boolean, d1 long, d2 long")
    again = rows.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1")
    rest = rows.filter("single").join(again, ["d1", "d2"], "left_semi").select("key", "s", (F.col("s") + size).alias("e"))
    spans = whole.union(some).union(rest).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return copies, spans


def removed(docs: DataFrame, size: int = 400, heavy: int = 20_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges)."""
    copies, spans = repeated_spans(docs, size, heavy)
    found = table(copies.join(spans, "key", "left").filter("copies > 1 or spans is not null"), "spans")
    full = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("key")).join(found, "key", "left")
    out = full.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    return out.mapInArrow(partial(_digest, size=size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: bigint, e: bigint>>")

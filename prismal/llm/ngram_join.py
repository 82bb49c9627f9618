"""Jaccard self-join on sets of word n-grams, with filters under several global token orders.

A set's prefix under an order holds so many of its first tokens that two sets whose Jaccard similarity reaches the
threshold share one there, whatever the order is. The first order puts n-grams first whose cell, in a bitmap over all documents,
was hit once: they stand in one set only and can't be shared, so a set with enough of them has nothing to join. N-grams that
repeat inside a part of the input come last; ties follow a 64-bit hash. What is left of the prefixes is joined. A pair stands only if the number of shared prefix tokens
leaves room for the overlap it needs (length and positional bounds) and so do the parities of both sets, and if its prefixes under two further orders
also meet: those prefixes alone are fetched for that, and whole sets only for the pairs that all three orders leave. Then the overlap is counted.

Copies of one set are one node. Links serve components: in each group of a shared token, members are first tried
with one representative, then with several, and only pairs that are still in different components are joined after that, each
at the first token that both share. So large groups of near copies cost a few tries per member, and yet every pair of different
components that the filters leave is verified.

Results are those of exact counting (of 64-bit hashes of the n-grams). Defined results: null texts and texts without
words have an empty set, linked with nothing; fewer words than n are one n-gram; repeated ids and rows are documents of
their own; a row with a null id takes part in links, and has a null component only where no id is in it; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import few, fresh, scratch, table
from prismal.llm.components import components

MIX, SALTS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words, A-Z lowered."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, "u8")
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _views(column: pa.Array, dtype: str = "u8") -> Iterator[np.ndarray]:
    """The values of a binary column as arrays over its own buffer, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i4")[column.offset : column.offset + len(column) + 1].tolist()
    values = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    for i in range(len(column)):
        part = values[at[i] : at[i + 1]]
        yield part.view(dtype) if part.ctypes.data % 8 == 0 else np.frombuffer(part.tobytes(), dtype)


SET_ROWS = "doc_id long, n long, node long, key long, token long, count long, slice int, cells binary"
SLICES = 64
#: Representatives of a group in each round of tries, and tokens of a node that rounds with several use.
REPS, TRY_TOKENS = (1, 8, 32), 3
#: Words of 64 bits of a set's parities. A bit says whether an odd number of the set's tokens has its place.
PARITY = 16
PARITIES = [f"b{k}" for k in range(PARITY)]


def _sets(batches: Iterator[pa.RecordBatch], n: int, bits: int, flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, node, key of the text), of tokens that repeat among the sets of this part (token, count), and of

    the cells that the tokens of this part hit, by slices of the bitmap (steps between sorted cells).
    """
    names = [x.split()[0] for x in SET_ROWS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
    held: list[np.ndarray] = []
    size, seen = 0, set()

    def batch(length: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(length, t) for k, t in zip(names, kinds, strict=True)], names)

    def gathered() -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(held) if held else np.zeros(0, "u8")
        token, count = np.unique(tokens, return_counts=True)
        again = count > 1
        yield batch(int(again.sum()), token=pa.array(token[again].view("i8")), count=pa.array(count[again]))
        cell = np.sort(np.concatenate([token, token[again]]) & np.uint64((1 << bits) - 1)).astype("i8")
        width = (1 << bits) // SLICES
        edges = np.searchsorted(cell, np.arange(SLICES + 1) * width)
        blobs = []
        for k in range(SLICES):
            steps = np.diff(cell[edges[k] : edges[k + 1]] - k * width, prepend=0)
            small = not len(steps) or steps.max() < 1 << 16
            blobs.append((b"2" if small else b"4") + steps.astype("<u2" if small else "<u4").tobytes())
        yield batch(SLICES, slice=pa.array(range(SLICES), pa.int32()), cells=pa.array(blobs, pa.binary()))

    for b in batches:
        sets = [shingles(t, n) for t in _binary(b.column(1))]
        nodes = [node_of(s) if len(s) else None for s in sets]
        yield batch(len(sets), doc_id=b.column(0), n=pa.array([len(s) for s in sets], pa.int64()), node=pa.array(nodes, pa.int64()), key=b.column(2))
        for s, k in zip(sets, nodes, strict=True):
            if k is not None and k not in seen:
                seen.add(k)
                held.append(s)
                size += len(s)
        if size > flush:
            yield from gathered()
            held, size, seen = [], 0, set()
    yield from gathered()


def _once(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of slices: per slice a bitmap of the cells that were hit exactly once."""
    width, now, hits = (1 << bits) // SLICES, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(hits == 1).tobytes()], pa.binary())], ["slice", "once"])

    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != now:
                if now is not None:
                    yield done()
                now, hits = k, np.zeros(width, "u1")
            cell = np.cumsum(np.frombuffer(blob[1:], "<u2" if blob[:1] == b"2" else "<u4").astype("i8"))
            cell, count = np.unique(cell, return_counts=True)
            hits[cell] = np.minimum(hits[cell] + np.minimum(count, 2).astype("u1"), 2)
    if now is not None:
        yield done()


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, late: tuple[np.ndarray, np.ndarray], once: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    token, count = late
    mask = np.uint64((1 << bits) - 1)
    seen: set[int] = set()
    for b in batches:
        out = []
        for t in _binary(b.column(0)):
            s = shingles(t, n)
            if not len(s) or (k := node_of(s)) in seen:
                continue
            seen.add(k)
            cell = s & mask
            alone = (once[(cell >> np.uint64(3)).astype("i8")] >> (np.uint64(7) - (cell & np.uint64(7))).astype("u1")) & 1 == 1
            skipped = int(alone.sum())
            size = prefix_size(len(s), percent) - skipped
            if size <= 0:
                continue
            rest = s[~alone]
            if len(token):
                at = np.minimum(np.searchsorted(token, rest), len(token) - 1)
                rest = rest[np.lexsort((rest, np.where(token[at] == rest, count[at], 0)))]
            out.append((rest[:size].view("i8"), k, len(s), skipped))
        if len(seen) > 200_000:
            seen.clear()
        sizes = [len(x[0]) for x in out]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x[0] for x in out]) if out else np.zeros(0, "i8")),
                pa.array(np.repeat(np.array([x[1] for x in out], "i8"), sizes)),
                pa.array(np.repeat(np.array([x[2] for x in out], "i4"), sizes)),
                pa.array(np.concatenate([np.arange(x[3], x[3] + k, dtype="i4") for x, k in zip(out, sizes, strict=True)]) if out else np.zeros(0, "i4")),
            ],
            ["token", "node", "n", "pos"],
        )


def parities(s: np.ndarray) -> np.ndarray:
    """PARITY words. Where those of two sets differ in a bit, a token of that place is in one of the sets only."""
    cell = ((s ^ (s >> np.uint64(29))) * MIX >> np.uint64(32)) % np.uint64(64 * PARITY)
    return np.packbits(np.bincount(cell.astype("i8"), minlength=64 * PARITY) & 1 == 1).view("<i8")


def _blobs(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted nodes, their prefixes under the further orders, and their parities."""
    for b in batches:
        sets = [(k, s) for k, s in zip(b.column(0).to_pylist(), (shingles(t, n) for t in _binary(b.column(1))), strict=True) if len(s) and node_of(s) == k]
        prefixes = [pa.array([_prefix(s, salt, percent).tobytes() for _, s in sets], pa.binary()) for salt in SALTS]
        bits = np.array([parities(s) for _, s in sets], "i8").reshape(len(sets), PARITY)
        columns = [pa.array([k for k, _ in sets], pa.int64()), *prefixes, pa.array([s.tobytes() for _, s in sets], pa.binary()), *(pa.array(bits[:, k]) for k in range(PARITY))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "p", "q", "s", *PARITIES])


def _prefix(s: np.ndarray, salt: np.uint64, percent: int) -> np.ndarray:
    """Tokens of the prefix under the order of a salt, sorted."""
    order = (s ^ (s >> np.uint64(31))) * salt
    size = prefix_size(len(s), percent)
    return np.sort(s[np.argpartition(order, size - 1)[:size]])


def _both_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs u, v whose prefixes meet under each further order."""
    for b in batches:
        keep = [all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in ((pu, pv), (qu, qv))) for pu, qu, pv, qv in zip(*(_views(b.column(k)) for k in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(_views(b.column(2)), _views(b.column(3)), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def fits(na: Column, nb: Column, overlap: Column, percent: int) -> Column:
    """Whether so large an overlap (an upper bound) can reach the threshold."""
    return (100 + percent) * overlap >= percent * (na + nb)


def _near(x: str, y: str, percent: int) -> Column:
    """Length filter, and the positional bound of one shared token."""
    n, m, p, q = (F.col(f"{a}.{k}") for k in ("n", "pos") for a in (x, y))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & fits(n, m, F.least(p, q) + 1 + F.least(n - p - 1, m - q - 1), percent)


def _room(x: str, y: str, percent: int) -> Column:
    """Whether the parities allow the threshold: bits that differ are tokens that only one of the sets holds."""
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in PARITIES[1:]), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _best(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """One pair per node: with the representative of a group, in another component, that it shares the most tokens with,

    if those tokens alone can do.
    """
    w = Window.partitionBy("token")
    chosen = placed.withColumn("r", F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos", "c")).over(w))
    apart = chosen.filter("c <> r.c")
    counted = apart.groupBy("node", F.col("r.node").alias("low")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("r.n").alias("m"), F.max("pos").alias("p"), F.max("r.pos").alias("q"))
    room = F.col("k") + F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1)
    best = counted.filter(fits(F.col("n"), F.col("m"), room, percent)).groupBy("node").agg(F.max(F.struct("k", "low")).alias("b"))
    return best.select(*_pair("b.low", "node")).distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of tokens that stand in more than one component."""
    w = Window.partitionBy("token")
    return placed.withColumn("a", F.min("c").over(w)).withColumn("b", F.max("c").over(w)).filter("a <> b").drop("a", "b")


def _several(placed: DataFrame, percent: int, turn: int, reps: int, bits: DataFrame) -> DataFrame:
    """Pairs of a node with up to reps members of its groups that are in another component. Near copies pick the same

    tokens, those of the least hashes, so a few tokens of each node do.
    """
    of_node = Window.partitionBy("node").orderBy(F.xxhash64("token", F.lit(turn)))
    tries = table(_mixed(placed).withColumn("i", F.row_number().over(of_node)).filter(F.col("i") <= TRY_TOKENS).drop("i").join(few(bits), "node"), "tries")
    of_token = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    chosen = tries.withColumn("i", F.row_number().over(of_token)).filter(F.col("i") <= reps).drop("i")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & _near("x", "y", percent)
    met = tries.alias("x").join(chosen.alias("y"), apart & _room("x", "y", percent))
    return met.select(*_pair("x.node", "y.node")).distinct()


def _first_met(mixed: DataFrame, percent: int, bits: DataFrame) -> DataFrame:
    """Every pair of nodes in different components that shares a prefix token and has room for its overlap, met once: at

    the first token that both prefixes hold.
    """
    side = table(mixed, "mixed")
    own = side.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("own"))
    full = side.join(own.select("node", F.col("own.token").alias("tokens"), F.col("own.pos").alias("places")), "node").join(few(bits), "node")
    both = F.array_intersect("x.tokens", "y.tokens")
    after = F.least(*(F.col(f"{a}.n") - F.get(f"{a}.places", (F.array_position(f"{a}.tokens", F.element_at(both, -1)) - 1).cast("int")) - 1 for a in ("x", "y")))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
    once = F.element_at(both, 1) == F.col("x.token")
    met = full.alias("x").join(full.alias("y"), apart & _near("x", "y", percent) & _room("x", "y", percent) & once & fits(F.col("x.n"), F.col("y.n"), F.size(both) + after, percent))
    return met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, demoted: int = 1_000_000, bits: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id of its component).

    demoted: how many of the most repeated tokens come last in the first order; they are broadcast. bits: the bitmap has
    2^bits cells, by default eight or more for each word there can be, up to 2^28 (32 MB), and is broadcast too. Both bound memory, not
    results: with more tokens than cells fewer are known to be alone.
    """
    spark = docs.sparkSession
    if bits is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = min(28, max(16, int(2 * size).bit_length()))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    first = table(rows.mapInArrow(partial(_sets, n=n, bits=bits), SET_ROWS), "sets")
    own = first.filter("n is not null").select("doc_id", "n", "node", "key")
    often = first.filter("token is not null").groupBy("token").agg(F.sum("count").alias("c")).filter("c >= 4").orderBy(F.desc("c"), "token").limit(demoted).toArrow()
    late = (often["token"].to_numpy().view("u8"), often["c"].to_numpy())
    order = np.argsort(late[0])
    late_shared = spark.sparkContext.broadcast((late[0][order], late[1][order]))  # demoted * 16 bytes at most

    sliced = first.filter("slice is not null").select("slice", "cells").repartition("slice").sortWithinPartitions("slice")
    bitmap = np.zeros((1 << bits) // 8, "u1")
    for r in sliced.mapInArrow(partial(_once, bits=bits), "slice int, once binary").toLocalIterator():  # SLICES rows
        part = np.frombuffer(r.once, "u1")
        bitmap[r.slice * len(part) : (r.slice + 1) * len(part)] = part
    once_shared = spark.sparkContext.broadcast(bitmap)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(batches, n, percent, late_shared.value, once_shared.value, bits)

    prefix = docs.select("text").mapInArrow(prefixes, "token long, node long, n int, pos int")
    w = Window.partitionBy("token")
    ranked = prefix.withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w)).filter("low <> high")
    groups = table(ranked.select("token", "node", "n", "pos").distinct(), "groups")
    for shared in (late_shared, once_shared):  # the groups are written: nothing reads these again
        shared.destroy()
    del bitmap

    # the sets of all nodes that have a token in common with another, made once; texts are found by their hash, whatever their ids
    nodes = table(groups.select("node").distinct(), "nodes")
    held = table(own.join(few(nodes), "node").groupBy("key").agg(F.min("node").alias("node")).select("node", "key"), "held")
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(few(held), "key").select("node", "text")
    blobs = table(texts.mapInArrow(partial(_blobs, n=n, percent=percent), "node long, p binary, q binary, s binary, " + ", ".join(f"{b} long" for b in PARITIES)).dropDuplicates(["node"]), "blobs")

    bits_of = blobs.select("node", *PARITIES)

    def side(name: str, *columns: str) -> DataFrame:
        return blobs.select(F.col("node").alias(name), *(F.col(c).alias(c + name) for c in columns))

    def verify(pairs: DataFrame) -> DataFrame:
        prefixes = pairs.join(side("u", "p", "q"), "u").join(side("v", "p", "q"), "v").select("u", "v", "pu", "qu", "pv", "qv")
        left = table(prefixes.mapInArrow(_both_meet, "u long, v long"), "met")
        both = left.join(side("u", "s"), "u").join(side("v", "s"), "v").select("u", "v", "su", "sv")
        return table(both.mapInArrow(partial(_verified, percent=percent), "u long, v long"), "links")

    # rounds of tries that are linear in the members of a group; what they leave in different components is joined after that
    comp, links, tried = None, None, None
    for turn, reps in enumerate(REPS):
        placed = groups if comp is None else groups.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
        placed = placed.select("token", "node", "n", "pos", F.col("node" if comp is None else "c").alias("c"))
        pairs = (_best if reps == 1 else partial(_several, reps=reps, bits=bits_of))(placed, percent, turn)
        pairs = table(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = verify(pairs)
        links = found if links is None else links.union(found)
        comp = table(components(links), "components")
    placed = groups.join(comp, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    more = verify(table(_first_met(_mixed(placed), percent, bits_of).join(tried, ["u", "v"], "left_anti"), "pairs"))
    comp = table(components(links.union(more)), "components")
    placed_docs = own.join(comp, "node", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    least = placed_docs.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    return placed_docs.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, that come first in their component (least doc_id). Rows that share an id

    and a text with another become one; a null id is a component of its own.
    """
    (i,) = fresh(docs, "_id")
    with scratch(docs.sparkSession) as keep:
        placed = classes(docs, n, percent).groupBy(F.col("doc_id").alias(i)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
        gone = keep(table(placed.filter("not first").select(i), "gone"))
    # those that go are fewer than those that stay, so the texts are seldom dealt; a null id meets none
    kept = docs.join(few(gone), F.col("doc_id") == F.col(i), "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])

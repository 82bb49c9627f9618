"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Its quantum is one token per 1/weight of virtual time, and the queue whose deficit
(target minus served) is largest is served next, so the order of service is that of the virtual times
(i + 1/2) / weight. A window takes the next `length` tokens of that order: it holds each source in its target
proportion to within a token or two, and what a source lacks or has too much of is carried into the next window. Because the
order is a formula, the state after any number of windows is found without serving those before: each shard of
documents starts with the deficits that the shards before it leave. Documents stand in their queue by a hash of id and text, so the packing is
the same in whatever order and partitions rows come; shards are ranges of that hash.

With no weights given the target is the corpus' own mixture, which lasts until the last window. With weights, a source
that runs dry leaves its share to the others.

Defined results: a null text is empty and packs its end id; a null source is a queue of its own; a null id stays null; repeated rows are
documents of their own; an empty table gives no row; other columns are ignored. Each source is a queue at any number of
sources; a task holds two numbers a source, and counts for CELLS / sources windows at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm import bpe, shards
from prismal.llm.common import new_dir, table

#: Sources times windows that a task computes at once.
CELLS = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def served(windows: np.ndarray, length: int, totals: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Tokens that each source (rows) has given once `windows` (columns) are full."""
    goal = np.minimum(np.maximum(windows, 0).astype("i8") * length, int(totals.sum()))

    def given(v: np.ndarray) -> np.ndarray:
        return np.minimum(totals[:, None], np.floor(v[None, :] * rates[:, None] + 0.5).astype("i8"))

    last = float(np.max((totals + 1) / rates)) if len(totals) else 1.0
    low = np.zeros(len(goal), "i8")  # non-negative doubles are ordered as their bits are
    high = np.full(len(goal), np.float64(last).view("i8"))
    while np.any(high - low > 1):
        mid = low + (high - low) // 2
        fits = given(mid.view("f8")).sum(0) <= goal
        low, high = np.where(fits, mid, low), np.where(fits, high, mid)
    base, over = given(low.view("f8")), given(high.view("f8"))
    step = over - base
    rest = goal - base.sum(0)
    before = np.cumsum(step, 0) - step
    return base + np.clip(rest[None, :] - before, 0, step)


def _encode(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    enc = bpe.encoder(path, kind)
    end = enc.pack([end_id])
    number = TaskContext.get().partitionId()
    shard, sources, tokens = shards.Shard(folder, number), {}, []
    for b in batches:
        ids = enc.encode([t or "" for t in b.column(2).to_pylist()])
        lengths = np.array([len(x) // enc.width + 1 for x in ids], "<i8")
        of = np.array([sources.setdefault(s, len(sources)) for s in b.column(1).to_pylist()], "<i8")
        tokens += [0] * (len(sources) - len(tokens))
        for k, n in zip(of, lengths, strict=True):
            tokens[k] += int(n)
        shard.write("ids", b"".join(x + end for x in ids))
        named = [i is not None for i in b.column(0).to_pylist()]
        shard.write("docs", np.stack([b.column(0).fill_null(0).to_numpy().astype("<i8"), np.array(named, "<i8"), of, lengths], 1).tobytes())
    shard.close()
    n = len(sources)
    yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([shard.stem] * n, pa.string()), pa.array([enc.width] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(list(sources), pa.string()), pa.array(tokens, pa.int64())], ["shard", "stem", "width", "ordinal", "source", "n_tokens"])


def _pieces(batches: Iterator[pa.RecordBatch], totals: np.ndarray, rates: np.ndarray, length: int, emit_ids: bool) -> Iterator[pa.RecordBatch]:
    margin = len(totals) // length + 2
    span = max(1, min(8192, CELLS // max(1, len(totals))))

    def rank(i: int, k: int) -> int:
        """About how many tokens of all queues are served before token i of queue k; ties can shift it by a token a queue."""
        return int(np.minimum(totals, np.floor((i + 0.5) / rates[k] * rates + 0.5)).sum())

    for b in batches:
        for row in b.to_pylist():
            ids = shards.mapped(row["stem"] + ".ids", f"<u{row['width']}")
            doc, named, of, size = np.array(shards.mapped(row["stem"] + ".docs", "<i8")).reshape(-1, 4).T
            end = np.cumsum(size)
            first = end - size
            by_source = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by_source], np.arange(len(row["parts"]) + 1))
            todo: dict[int, list] = {}  # by range of windows: the parts that may have tokens there
            for part in sorted(row["parts"], key=lambda p: p["ordinal"]):
                mine, k = by_source[bounds[part["ordinal"]] : bounds[part["ordinal"] + 1]], part["queue"]
                starts = part["base"] + np.concatenate([[0], np.cumsum(size[mine])])
                edge = [max(0, rank(i, k) // length - margin) for i in (starts[0], starts[-1])]
                for turn in range(edge[0] // span, (edge[1] + 2 * margin) // span + 1):
                    todo.setdefault(turn, []).append((part["source"], k, mine, starts))
            for turn in sorted(todo):
                w = np.arange(turn * span, (turn + 1) * span + 1)
                every = served(w, length, totals, rates)
                leads = np.diff(every, axis=1)  # what the queues before one put into each window
                leads = np.cumsum(leads, 0) - leads
                for source, k, mine, starts in todo[turn]:
                    cum, lead = every[k], leads[k]
                    low, high = max(starts[0], cum[0]), min(starts[-1], cum[-1])
                    if low >= high:
                        continue
                    inner = np.concatenate([starts, cum])
                    cuts = np.unique(np.concatenate([[low, high], inner[(inner > low) & (inner < high)]]))
                    left, right = cuts[:-1], cuts[1:]
                    which = np.searchsorted(starts, left, "right") - 1
                    window = np.searchsorted(cum, left, "right") - 1
                    d = mine[which]
                    begin = left - starts[which]
                    a, z = first[d] + begin, first[d] + begin + (right - left)
                    wide = ids[a.min() : z.max()].astype("<u4")
                    shift = int(a.min())
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * (i - shift) : 4 * (j - shift)]) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                    out = {"doc_id": pa.array(doc[d], mask=named[d] == 0), "start": begin, "length": right - left, "ids_crc32": np.array(crc, "i8"), "doc_tokens": size[d], "sequence_id": w[window], "offset": lead[window] + left - cum[window], "source": pa.array([source] * len(d), pa.string())}
                    if emit_ids:
                        out["ids"] = pa.array([wide[i - shift : j - shift].astype("i4") for i, j in zip(a, z, strict=True)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)


def pack(df: DataFrame, tokenizer: str, kind: str, end_id: int, length: int = 2048, weights: dict[str, float] | None = None, emit_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, source, text) in sequences of `length` tokens; only the last is shorter.

    weights: target share by source (any positive scale; sources not named get the smallest); None: the corpus' mixture.
    """
    folder = new_dir(df.sparkSession, "packing")
    place = F.xxhash64("doc_id", "text")
    rows = df.select(F.col("doc_id").cast("long"), "source", "text", place.alias("place"))
    rows = rows.repartitionByRange("place").sortWithinPartitions("place", "doc_id", "source").select("doc_id", "source", "text")
    found = table(rows.mapInArrow(partial(_encode, path=tokenizer, kind=kind, end_id=end_id, folder=folder), "shard long, stem string, width int, ordinal long, source string, n_tokens long"), "packing-manifest")
    sums = found.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    named = table(sums.withColumn("queue", F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))) - 1), "packing-queues")  # a row per source
    rows = named.orderBy("queue").toArrow()
    totals = rows["n"].to_numpy().astype("i8")
    rates = totals.astype("f8")
    if weights:
        least = min(weights.values())
        rates = np.array([weights.get(q, least) for q in rows["source"].to_pylist()], "f8")
    shared = df.sparkSession.sparkContext.broadcast((totals, rates))
    queues = named.select(F.col("source").alias("_source"), "queue")
    before = Window.partitionBy("queue").orderBy("shard", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    based = found.join(queues, F.col("source").eqNullSafe(F.col("_source"))).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    plan = based.groupBy("shard", "stem", "width").agg(F.collect_list(F.struct("ordinal", "source", "queue", "base")).alias("parts"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, *shared.value, length, emit_ids)

    # a task a shard: left to itself, Spark would put the short plan into one task
    return plan.repartition(max(1, found.select("shard").distinct().count())).mapInArrow(pieces, PIECES + (", ids array<int>" if emit_ids else ""))

"""Token-ID files: flat unsigned integers plus 64-bit document offsets, in ascending document order.

Layout of a data set: per shard `<stem>.ids` (token ids, uint16 or uint32 little-endian), `<stem>.doc` (int64 document
ids) and `<stem>.idx` (uint64, n+1 entries: where each document's ids start counted over the whole data set). Shards
are ranges of document ids; a shard's base is the exclusive prefix sum of the token counts of the shards before it.

Defined results: a null text is an empty one (it still gets the end id); documents with a null id come first (a shard's manifest counts them, their place in its ids is 0) and stay null; repeated
ids are documents of their own, in the order of their texts; an empty table gives no shard and no row; other
columns are ignored.
"""

from __future__ import annotations

import uuid
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

MANIFEST = "shard long, stem string, width int, n_docs long, n_null long, n_tokens long"


def _write(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    enc = bpe.encoder(path, kind)
    end = enc.pack([end_id])
    number = TaskContext.get().partitionId()
    shard, docs, nulls, tokens = shards.Shard(folder, number), 0, 0, 0
    for b in batches:
        ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
        lengths = np.array([len(x) // enc.width + 1 for x in ids], "<u8")
        shard.write("ids", b"".join(x + end for x in ids))
        shard.write("len", lengths.tobytes())
        shard.write("doc", b.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
        docs += len(ids)
        nulls += b.column(0).null_count
        tokens += int(lengths.sum())
    shard.close()
    if docs:
        yield pa.RecordBatch.from_pydict({"shard": [number], "stem": [shard.stem], "width": pa.array([enc.width], pa.int32()), "n_docs": [docs], "n_null": [nulls], "n_tokens": [tokens]})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write each shard's offsets, now that its base is known."""
    for b in batches:
        for row in b.to_pylist():
            lengths = shards.mapped(row["stem"] + ".len", "<u8")
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])
            system, path = shards.target(row["stem"] + ".idx")
            part = f"{path}.{uuid.uuid4().hex}"  # another attempt of the task writes beside it
            with system.open_output_stream(part) as f:
                f.write(offsets.tobytes())
            system.move(part, path)
        yield b


def write(df: DataFrame, tokenizer: str, kind: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write documents (doc_id, text) to token files; returns the manifest, one row per shard, with its base."""
    folder = folder or new_dir(df.sparkSession, "tokens")
    rows = df.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = table(rows.mapInArrow(partial(_write, path=tokenizer, kind=kind, end_id=end_id, folder=folder), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = found.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return table(based.repartition(max(1, found.count())).mapInArrow(_index, MANIFEST + ", base long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = shards.mapped(row["stem"] + ".ids", f"<u{row['width']}")
            idx = shards.mapped(row["stem"] + ".idx", "<u8").astype("i8")
            doc = shards.mapped(row["stem"] + ".doc", "<i8")
            local = idx - row["base"]
            for at in range(0, len(doc), 4096):
                to = min(at + 4096, len(doc))
                crc = [zlib.crc32(ids[local[i] : local[i + 1]].astype("<u4").data) for i in range(at, to)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(doc[at:to]), mask=np.arange(at, to) < row["n_null"]), "start": idx[at:to], "n_tokens": np.diff(idx[at : to + 1]), "ids_crc32": np.array(crc, "i8"), "shard": np.full(to - at, row["shard"])})


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit), shard."""
    # a task a shard: left to itself, Spark would put the short manifest into one task
    return manifest.repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def ids_of(manifest: DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
    """On the driver, shard after shard: (document id, memory-mapped ids). For small sets and for tests."""
    for row in manifest.orderBy("shard").toLocalIterator():
        ids = shards.mapped(row.stem + ".ids", f"<u{row.width}")
        idx = shards.mapped(row.stem + ".idx", "<u8").astype("i8") - row.base
        for k, doc in enumerate(shards.mapped(row.stem + ".doc", "<i8")):
            yield None if k < row.n_null else int(doc), ids[idx[k] : idx[k + 1]]

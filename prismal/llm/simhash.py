"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

A bit of a fingerprint is 1 where it is in over half of the XXH64 hashes of a text's shingles, repeats included. Equal fingerprints
are one node. The 64 bits are split into four blocks; of two fingerprints that differ in two bits or fewer at least two blocks
are equal (pigeonhole), so nodes are joined on the six pairs of blocks, 32 bits each, and the distance of each pair that meets is
verified. A bucket of over `crowd` nodes isn't paired: each node goes to itself and to the points one bit away in the other two
blocks. Nodes that share such a point differ in two bits at most, and any two that differ in two or fewer share one, so linking
each to the least node at the point (verified too) gives the same components, with 33 rows a node instead of pairs.

Components are found by distributed union-find over links. Joins of documents with nodes are by fingerprint, whose copies Spark's skew join can
split; everything else is over distinct fingerprints.

Defined results: null and empty texts, and those without words, have fingerprint zero, which links like any other; fewer words than
the shingle's size are one shingle; repeated rows are documents of their own; a row with a null doc_id takes part in links, and has a
null component only where no id is in it; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import drop_table, few, fresh, table
from prismal.llm.components import components

DISTANCE = 2
#: Bytes of a text that are hashed at a time, up to the next blank.
CHUNK = 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of words."""
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[s:e], seed) for s, e in zip(starts, stops, strict=True)], ">u8")


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned. A long text is taken in pieces that overlap by size - 1 words."""
    text = (text or b"").lower()  # bytes: A-Z only, and only ASCII blanks below
    counts, n, at, words = np.zeros(64, "i8"), 0, 0, []
    while at < len(text):
        blank = BLANK.search(text, at + CHUNK)
        end = blank.start() if blank else len(text)
        words += text[at:end].split()
        at = end
        if len(words) < size and (n or at < len(text)):
            continue
        if words:
            hashes = _hashes(words, min(size, len(words)), seed)
            counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
            n += len(hashes)
            words = words[len(words) - size + 1 :] if size > 1 else []
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t, size, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], "u8").view("i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "print"])


def prints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and print (a long of the fingerprint's 64 bits) per row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_prints, size=size, seed=seed), "doc_id long, print long")


def _distance(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def _block(k: int) -> Column:
    return F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF))


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def links(nodes: DataFrame, distance: int = DISTANCE, crowd: int = 32) -> DataFrame:
    """nodes: distinct print. Returns u, v: links that join up every two nodes of `distance` (two at most) or fewer bits."""
    if not 0 <= distance <= 2:
        raise ValueError("four blocks, of which two agree, serve distances up to 2")
    pairs = list(combinations(range(4), 2))
    keys = F.array(*(F.struct(F.lit(i).alias("pair"), F.shiftleft(_block(a), 16).bitwiseOR(_block(b)).alias("value")) for i, (a, b) in enumerate(pairs)))
    filed = table(nodes.select("print", F.explode(keys).alias("k")).select("print", "k.pair", "k.value"), "filed")
    sizes = table(filed.groupBy("pair", "value").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    small = filed.join(few(sizes.filter(F.col("n") <= crowd).select("pair", "value")), ["pair", "value"], "left_semi")
    met = small.alias("x").join(small.alias("y"), ["pair", "value"]).filter("x.print < y.print").select(F.col("x.print").alias("u"), F.col("y.print").alias("v"))
    crowded = filed.join(few(sizes.filter(F.col("n") > crowd).select("pair", "value")), ["pair", "value"])
    others = F.array(*(F.array(*(F.lit(_bit(16 * k + b)).cast("long") for k in range(4) if k not in p for b in range(16))) for p in pairs))
    points = F.concat(F.array("print"), F.transform(F.element_at(others, F.col("pair") + 1), lambda bit: F.col("print").bitwiseXOR(bit)))
    near = crowded.select("print", "pair", F.explode(points).alias("point"))
    least = near.groupBy("pair", "point").agg(F.min("print").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = near.join(least, ["pair", "point"]).filter("print <> least").select(F.col("least").alias("u"), F.col("print").alias("v"))
    found = table(met.union(shared).filter(_distance("u", "v") <= distance).distinct(), "links")
    for t in (filed, sizes):
        drop_table(t)
    return found


def classes(docs: DataFrame, size: int = 3, distance: int = DISTANCE, seed: int = 42) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the least doc_id of its component)."""
    own = table(prints(docs, size, seed), "prints")
    nodes = table(own.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    found = table(components(links(nodes.select("print"), distance)), "components")
    named = nodes.join(found, nodes["print"] == found["node"], "left").select("print", "least", F.coalesce("component", "print").alias("c"))
    # only components of several nodes need a least id of their own; the rest have their node's
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    placed = table(named.join(least, "c").select("print", "component_id"), "placed")
    return own.join(few(placed), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, all their columns, that come first in their component (least doc_id); rows without an id stay, rows that share an id and a text become one."""
    (i,) = fresh(docs, "_id")
    found = classes(docs, size, distance).filter("doc_id = component_id").select(F.col("doc_id").alias(i)).distinct()
    kept = docs.join(found, F.col("doc_id") == F.col(i), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.union(docs.filter("doc_id is null"))

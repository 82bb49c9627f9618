"""Merkle manifest of a data set: a leaf per row, a tree per group, a tree over the groups' roots, and a proof per row.

Leaves are ordered by a range partitioning, so a group of any size is dealt over tasks; their places are those inside a partition plus
the counts of the partitions before. Leaves are cut into aligned blocks of 2^levels, each a subtree. A first pass takes the roots of
blocks by a treehash stack; they are the leaves of the next tree up, and so on until one node is left. Authentication paths then come down: in
every block the traversal schedule goes from leaf to leaf, with one treehash instance for each height that is advanced two steps a
leaf, so that the next sibling at each height is ready when it is due. Besides the block's own leaves only their stacks are held, logarithmic in the
block. Each path is continued by the path of its block's root, which all leaves of the block share: it comes as the block's first row.

Digests are lowercase hex text and are hashed as such. A last node without a partner becomes the hash of itself alone.

Defined results: a null value is `-` in its leaf; a null group is a group of its own and comes first; null ids come first; equal ids follow by
leaf; repeated rows are leaves of their own; an empty table gives no row; columns not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import drop_table, few, table

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _join(left: str | None, right: str | None) -> str | None:
    """The node over two, of which the right or both may be missing."""
    if left is None:
        return None
    return _digest(left) if right is None else _digest(left, right)


class Treehash:
    """The node of a height from a leaf on, made by a stack that holds two nodes of a height at most."""

    def __init__(self, leaves: Sequence[str], start: int, height: int) -> None:
        self.leaves, self.at, self.height = leaves, start, height
        self.stack: list[tuple[int, str | None]] = []

    @property
    def done(self) -> bool:
        return bool(self.stack) and self.stack[0][0] == self.height

    def step(self) -> None:
        """One leaf or one join."""
        s = self.stack
        if s and s[0][0] == self.height:
            return
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (h, right), (_, left) = s.pop(), s.pop()
            s.append((h + 1, _join(left, right)))
        elif self.at >= len(self.leaves):  # nothing from here on: the highest node that starts here is missing too
            s.append((s[-1][0] if s else self.height, None))
        else:
            s.append((0, self.leaves[self.at]))
            self.at += 1

    def finish(self) -> str | None:
        while not self.done:
            self.step()
        return self.stack[0][1]


def height_of(n: int, whole: bool, levels: int) -> int:
    """Levels of a block of n leaves: until one node is left where it is the whole tree, else all."""
    return (n - 1).bit_length() if whole else levels


def paths(leaves: Sequence[str], height: int) -> Iterator[list[str]]:
    """Per leaf its siblings from below: "L" or "R" (the side it stands on) and digest, or "" where there is none."""
    auth = [Treehash(leaves, 1 << h, h).finish() for h in range(height)]
    ready = [Treehash(leaves, 0, h) for h in range(height)]
    for t in ready:
        t.finish()
    for leaf in range(len(leaves)):
        yield ["" if auth[h] is None else ("L" if leaf >> h & 1 else "R") + auth[h] for h in range(height)]
        for h in range(height):
            if (leaf + 1) % (1 << h):
                break
            auth[h] = ready[h].finish()  # its schedule of two steps a leaf has done it
            ready[h] = Treehash(leaves, (leaf + 1 + (1 << h)) ^ (1 << h), h)
        for t in ready:
            t.step()
            t.step()


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path give."""
    for s in path:
        leaf = _digest(leaf) if not s else _digest(s[1:], leaf) if s[0] == "L" else _digest(leaf, s[1:])
    return leaf


def leaf(fields: Sequence[str], **changed: Column) -> Column:
    """Digest of a row: each field's length in bytes and its value; changed: other values of fields."""
    text = [changed.get(c, F.col(c)).cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def placed(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with `at` (its place in its group, from 0) and `n` (rows of the group), as a written table."""
    keys = [F.asc_nulls_first(k) for k in (group, *order)]
    dealt = table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_row", 33)
    runs = dealt.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_row").alias("_first"), F.count("*").alias("_own"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_own").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = table(runs.withColumn("_before", before).withColumn("n", F.sum("_own").over(w)).select("_g", "_p", (F.col("_before") - F.col("_first")).alias("_shift"), "n"), "runs")  # a row a partition and group
    joined = dealt.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    out = table(joined.select(*df.columns, (F.col("_row") + F.col("_shift")).alias("at"), "n"), "placed")
    drop_table(dealt)
    drop_table(runs)
    return out


def _dealt(nodes: DataFrame, levels: int, heads: DataFrame | None = None) -> DataFrame:
    """Nodes (tree, n, at, node, ...) in the order of blocks of 2^levels; heads (tree, block, ...) come as the first rows of their blocks."""
    rows = nodes.withColumn("block", F.shiftright("at", levels))
    if heads is not None:
        rows = rows.unionByName(heads.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tree and block, a table for each block."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = list(zip(b.column("tree").to_pylist(), b.column("block").to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            if keys[at] != now:
                if held:
                    yield pa.Table.from_batches(held)
                now, held = keys[at], []
            end = at + 1
            while end < len(keys) and keys[end] == now:
                end += 1
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _lists(block: pa.Table, *names: str) -> list[list]:
    return [block[n].to_pylist() for n in names]


def _roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        n, node = block["n"][0].as_py(), block["node"].to_pylist()
        root = Treehash(node, 0, height_of(len(node), n <= 1 << levels, levels)).finish()
        yield pa.RecordBatch.from_arrays([block["tree"].chunk(0)[:1], block["block"].chunk(0)[:1], pa.array([root])], ["tree", "at", "node"])


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes (tree, n, at, node) and the levels over them, each the roots of the blocks of the one before, until every tree is one node."""
    made = [nodes]
    while True:
        now = _dealt(made[-1].select("tree", "n", "at", "node"), levels)
        up = table(now.mapInArrow(partial(_roots, levels=levels), "tree long, at long, node string"), "block-roots")
        counts = up.groupBy("tree").agg(F.count("*").alias("n"))
        made.append(up.join(few(table(counts, "tree-sizes")), "tree"))
        if (counts.agg(F.max("n")).first()[0] or 1) == 1:
            return made


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        tree, at, n, node, above = _lists(block, "tree", "at", "n", "node", "above")
        node = node[1:]
        each = [p + above[0] for p in paths(node, height_of(len(node), n[1] <= 1 << levels, levels))]
        yield pa.RecordBatch.from_arrays([pa.array(tree[1:], pa.int64()), pa.array(at[1:], pa.int64()), pa.array(each, pa.list_(pa.string()))], ["tree", "block", "above"])


def descend(made: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """tree, block, above: paths of the roots of the lowest blocks. top: tree, above (the path of each tree's own root)."""
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "above")
    for nodes in reversed(made[1:-1]):
        above = _dealt(nodes, levels, above).mapInArrow(partial(_paths, levels=levels), "tree long, block long, above array<string>")
    return table(above, "upper-paths")


PROOF = "id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _proofs(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PROOF.split(", ")]
    for block in _by_block(batches):
        n, node, ids, shown, above = _lists(block, "n", "node", "id", "shown", "above")
        subroot, leaves = node[0], node[1:]
        proof, fold = [], []
        for x, below in zip(shown[1:], paths(leaves, height_of(len(leaves), n[1] <= 1 << levels, levels)), strict=True):
            path = below + above[0]
            proof.append(_digest(*(s[1:] for s in path if s)))
            fold.append(folded(x, path))
        yield pa.RecordBatch.from_arrays([pa.array(ids[1:], pa.int64()), *(pa.array(c, pa.string()) for c in (leaves, [subroot] * len(leaves), proof, fold))], names)


def manifest(df: DataFrame, shown: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """Per row of df: id (of key), leaf, subroot (of its group), root, proof_sha256, folded_root, verified (folded_root equals root).

    shown: the leaf as it is presented for verification with the proof of the row, by default its own.
    """
    own = leaf(fields)
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("id"), own.alias("node"), (own if shown is None else shown).alias("shown"))
    leaves = placed(rows, "g", "id", "node")
    groups = placed(leaves.select("g").distinct().withColumn("all", F.lit(0)), "all", "g").select("g", F.col("at").alias("tree"), F.col("n").alias("trees"))
    named = leaves.join(groups.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("tree", "n", "at", "node", "id", "shown")
    made = climb(named, levels)
    subroots = table(made[-1].select("tree", "node"), "subroots")
    over = subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("at"), "node")
    top = climb(over, levels)
    root = top[-1].select("node").first()  # one value
    nothing = F.array().cast("array<string>")
    # a path of each subroot: those of its block above it and, in the block, its own
    upper = descend(top, top[-1].select("tree", nothing.alias("above")), levels)
    of_tree = _dealt(over, levels, upper).mapInArrow(partial(_paths, levels=levels), "tree long, block long, above array<string>").select(F.col("block").alias("tree"), "above")
    heads = descend(made, of_tree, levels).join(subroots, "tree")
    out = _dealt(named, levels, heads).mapInArrow(partial(_proofs, levels=levels), PROOF)
    root_value = F.lit(root.node if root else None).cast("string")
    return out.select("id", "leaf", "subroot", root_value.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_value).alias("verified"))

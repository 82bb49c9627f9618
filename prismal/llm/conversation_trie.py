"""Trie of the prefixes of conversations: nodes with their members, children, leaves and the words that sharing them saves.

A turn has a 64-bit hash; the fingerprint of a prefix is the sum of hash * base^depth under two primes below 2^31, taken by numpy scans
over turns in order. Prefixes of one depth and fingerprint are a group, its least conversation the representative. Groups are
verified turn by turn: turns are summed by group and by the whole role and text, and a turn that isn't the representative's is split
off under the least conversation that has it. As equal fingerprints with equal last turns have equal fingerprints before that
turn, a group whose turns all agree at every depth holds equal prefixes; below a turn that was split off, the splits above are part of
the key. Figures of subtrees go to parents along the path of each node's least member: a node's least member is also that of all nodes
below it on its path, so one running sum per conversation and one sum per node do for any depth.

Long conversations are cut into blocks of `BLOCK` turns, whose counts and sums are carried on afterwards, so no task holds a whole one.
Sums by node are partial before they are dealt; ids of a node's last members are joined to pieces in the order of a range partitioning and
hashed piece by piece. Only rows of numbers are joined; texts move once to be ordered, and again where different turns share a group.

Defined results: a null role or text is empty; turns that share a number follow by role and text, a null number comes first; repeated
rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import drop_table, few, table

BLOCK = 4096
#: Moduli and bases of the two fingerprints.
PRIMES, BASES = (2147483629, 2147483587), (1103515245, 1664525013)
KEY = ["depth", "a", "b", "tag"]
WORD = r"[^\x20\x09-\x0D]+"


def _before(totals: DataFrame, group: str, order: Column, *sums: str) -> DataFrame:
    """Totals of blocks as running sums over the blocks of a group up to and with each one."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.select(group, "block", *(F.sum(s).over(w).alias(s) for s in sums))


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), role, text, words, hash of every turn, as a written table."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn = F.col("turn").cast("long")
    block = F.coalesce(F.expr(f"cast(turn as bigint) div {BLOCK}"), F.lit(-(1 << 62)))
    rows = conversations.filter("conv_id is not null").select("conv_id", turn.alias("turn"), block.alias("block"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    upto = _before(counts, "conv_id", F.col("block"), "n").join(counts.withColumnRenamed("n", "own"), ["conv_id", "block"])
    carried = table(upto.select("conv_id", "block", (F.col("n") - F.col("own")).alias("carried")).filter("carried > 0"), "turn-counts")
    w = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(w) - 1).join(few(carried), ["conv_id", "block"], "left")
    rank = F.col("at") + F.coalesce("carried", F.lit(0))
    out = placed.select("conv_id", rank.cast("long").alias("rank"), "role", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("role", "text").alias("hash"))
    made = table(out, "turns")
    drop_table(carried)
    return made


PREFIX = ["conv_id", "depth", "hash", "words", "ref_conv", "ref_rank", "ends"]


def plain(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: a row per turn from depth 1 on, and one at depth 0."""
    last = turns.groupBy("conv_id").agg((F.max("rank") + 1).alias("n"))
    rows = turns.join(last, "conv_id").select("conv_id", (F.col("rank") + 1).alias("depth"), "hash", "words", F.col("conv_id").alias("ref_conv"), F.col("rank").alias("ref_rank"), (F.col("rank") + 1 == F.col("n")).alias("ends"))
    return rows.union(_roots(last.select("conv_id", F.lit(False).alias("ends"))))


def _roots(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", zero.alias("depth"), zero.alias("hash"), zero.alias("words"), zero.alias("ref_conv"), zero.alias("ref_rank"), "ends")


def branched(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt as branches: the first h turns of conversation c - c % every, then c's own turns after its first h; h = crc32(c) % heads.

    Turns that come from elsewhere are kept as references; texts aren't copied.
    """
    convs = turns.groupBy("conv_id").agg((F.max("rank") + 1).alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = table(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("rank") < heads)).select(F.col("conv_id").alias("base"), "rank", "hash", "words")
    copied = convs.join(first, "base").filter("rank < taken")
    copied = copied.select("conv_id", (F.col("rank") + 1).alias("depth"), "hash", "words", F.col("base").alias("ref_conv"), F.col("rank").alias("ref_rank"), (F.col("rank") + 1 == F.col("length")).alias("ends"))
    own = turns.select("conv_id", "rank", "hash", "words").join(convs, "conv_id").filter("rank >= h")
    depth = F.col("rank") - F.col("h") + F.col("taken") + 1
    own = own.select("conv_id", depth.alias("depth"), "hash", "words", F.col("conv_id").alias("ref_conv"), F.col("rank").alias("ref_rank"), (depth == F.col("length")).alias("ends"))
    return own.union(copied).union(_roots(convs.select("conv_id", (F.col("length") == 0).alias("ends"))))


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(BLOCK, "u8")
    for k in range(1, BLOCK):
        out[k] = int(out[k - 1]) * base % prime
    return out


def _scan(batches: Iterator[pa.RecordBatch], primes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Prefix sums of the terms over rows sorted by conversation and depth, from zero at every block; carried from batch to batch."""
    tables = [_powers(b % p, p) for b, p in zip(BASES, primes, strict=True)]
    last, sums = None, [0] * len(primes)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, turn = (batch.column(k).to_numpy() for k in range(3))
        block = depth // BLOCK
        starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(conv)]))
        goes_on = last == (conv[0], block[0])
        columns = []
        for k, prime in enumerate(primes):
            lifted = np.array([pow(BASES[k], int(b) * BLOCK, prime) for b in block[starts]], "u8")[run]
            power = tables[k][depth % BLOCK] * lifted % np.uint64(prime)
            term = np.where(depth > 0, (turn.view("u8") % np.uint64(prime) + np.uint64(1)) % np.uint64(prime) * power % np.uint64(prime), np.uint64(0))
            total = np.cumsum(term)  # below 2^31 each, so a batch doesn't overflow
            total = total - np.r_[np.uint64(0), total[starts[1:] - 1]][run]
            if goes_on:
                total[run == 0] += np.uint64(sums[k])
            total %= np.uint64(prime)
            sums[k] = int(total[-1])
            columns += [total.astype("i8"), ((total + np.uint64(prime) - term) % np.uint64(prime)).astype("i8")]
        last = (conv[-1], block[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in columns)], [*PREFIX, "a", "pa", "b", "pb"])


def prefixes(rows: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Rows of plain() or branched() with the fingerprints a, b of the prefix and pa, pb of the one before, as a written table."""
    dealt = rows.select(*PREFIX).repartition(F.col("conv_id"), F.floor(F.col("depth") / BLOCK)).sortWithinPartitions("conv_id", "depth")
    kinds = "conv_id long, depth long, hash long, words long, ref_conv long, ref_rank long, ends boolean, a long, pa long, b long, pb long"
    found = table(dealt.mapInArrow(lambda batches: _scan(batches, primes), kinds), "scanned")
    full = found.filter(F.col("depth") % BLOCK == BLOCK - 1).select("conv_id", F.floor(F.col("depth") / BLOCK).alias("block"), "a", "b")
    carried = table(_before(full, "conv_id", F.col("block"), "a", "b").select("conv_id", (F.col("block") + 1).alias("block"), F.col("a").alias("ca"), F.col("b").alias("cb")), "carried")
    joined = found.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(few(carried), ["conv_id", "block"], "left")
    add = lambda c, by, p: F.pmod(F.col(c) + F.coalesce(F.col(by), F.lit(0)), F.lit(p)).cast("long").alias(c)
    out = table(joined.select("conv_id", "depth", "words", "ref_conv", "ref_rank", "ends", add("a", "ca", primes[0]), add("pa", "ca", primes[0]), add("b", "cb", primes[1]), add("pb", "cb", primes[1])), "prefixes")
    drop_table(found)
    drop_table(carried)
    return out


def split_off(found: DataFrame, turns: DataFrame) -> DataFrame | None:
    """conv_id, depth, label of the prefixes whose last turn isn't that of their group's representative; None if there are none."""
    group = KEY[:3]
    own = F.struct("ref_conv", "ref_rank")
    mixed = found.filter("depth > 0").groupBy(*group).agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo <> hi").select(*group)
    mixed = table(mixed, "mixed")
    members = found.join(few(mixed), group).groupBy(*group, "ref_conv", "ref_rank").agg(F.min("conv_id").alias("conv_id"))
    texts = turns.select(F.col("conv_id").alias("ref_conv"), F.col("rank").alias("ref_rank"), "role", "text")
    contents = table(members.join(texts, ["ref_conv", "ref_rank"]).groupBy(*group, "role", "text").agg(F.min("conv_id").alias("label")), "contents")
    several = contents.groupBy(*group).agg(F.min("label").alias("representative"), F.count("*").alias("n")).filter("n > 1")
    others = table(contents.join(several, group).filter("label <> representative").select(*group, "role", "text", "label"), "others")
    if others.isEmpty():
        for t in (mixed, contents, others):
            drop_table(t)
        return None
    rows = found.join(few(mixed), group).join(texts, ["ref_conv", "ref_rank"])
    return rows.join(others, [*group, "role", "text"]).select("conv_id", "depth", "label")


def tagged(found: DataFrame, turns: DataFrame) -> DataFrame:
    """found with tag and ptag: the splits on the path down to a prefix, and down to the one before."""
    splits = split_off(found, turns)
    if splits is None:
        return found.withColumn("tag", F.lit("")).withColumn("ptag", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("label").isNotNull(), F.concat_ws(":", "depth", "label"))
    marked = found.join(splits, ["conv_id", "depth"], "left").withColumn("tag", F.array_join(F.collect_list(mark).over(w), ","))
    return marked.drop("label").withColumn("ptag", F.coalesce(F.lag("tag").over(Window.partitionBy("conv_id").orderBy("depth")), F.lit("")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in rows sorted by node and conversation, as text."""
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for k in range(3):
            c = b.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        tags = b.column(3).to_numpy(zero_copy_only=False)
        change[1:] |= tags[1:] != tags[:-1]
        starts = np.flatnonzero(change)
        ids = b.column(4).to_pylist()
        ends = [*starts[1:].tolist(), len(ids)]
        text = [",".join(map(str, ids[s:e])) for s, e in zip(starts.tolist(), ends, strict=True)]
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(5)), pa.array(text, pa.string())], [*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, in order; the state is all that is held."""
    now, state = None, None
    for b in batches:
        done = []
        columns = [b.column(k).to_pylist() for k in range(4)] + [b.column(5).to_pylist()]
        for *key, ids in zip(*columns, strict=True):
            if key != now:
                if now is not None:
                    done.append([*now, state.hexdigest()])
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield _hash_rows(done)
    if now is not None:
        yield _hash_rows([[*now, state.hexdigest()]])


def _hash_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "ends_sha256"])


def _ends(found: DataFrame) -> DataFrame:
    key = "depth long, a long, b long, tag string"
    last = found.filter("ends").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = last.mapInArrow(_pieces, f"{key}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, f"{key}, ends_sha256 string")


def _subtrees(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node the sums of `saved` and `leaf` over its subtree, along the paths of the nodes' least members."""
    own = nodes.select("conv_id", "depth", "saved", "leaf")
    rows = found.select("conv_id", *KEY).join(own, ["conv_id", "depth"], "left").withColumn("block", F.floor(F.col("depth") / BLOCK))
    rows = rows.fillna(0, ["saved", "leaf"])
    later = own.withColumn("block", F.floor(F.col("depth") / BLOCK)).filter("block > 0").groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    # a block without nodes of its own lies above the chain of its conversation's nodes; so all nodes that count are in the blocks listed
    later = _before(later, "conv_id", F.desc("block"), "saved", "leaf")
    first = Window.partitionBy("conv_id").orderBy("block")
    later = later.withColumn("from", F.coalesce(F.lag("block").over(first), F.lit(0)))
    spread = later.select("conv_id", F.explode(F.sequence("from", F.col("block") - 1)).alias("block"), F.col("saved").alias("more_saved"), F.col("leaf").alias("more_leaf"))
    carried = table(spread, "later-blocks")
    w = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumn("saved", F.sum("saved").over(w)).withColumn("leaf", F.sum("leaf").over(w)).join(few(carried), ["conv_id", "block"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)))
    return sums.groupBy(*KEY).agg(total("saved").alias("saved_tokens"), total("leaf").alias("n_leaves"))


def trie(turns: DataFrame, rows: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Nodes of the trie of `rows` (plain(turns) or branched(turns)): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    plain_rows = prefixes(rows, primes)
    found = table(tagged(plain_rows, turns), "members")
    drop_table(plain_rows)
    summed = found.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("ptag").alias("ptag"))
    nodes = table(summed, "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("ptag").alias("tag")).agg(F.count("*").alias("n_children"))
    counted = table(nodes.join(below, KEY, "left").fillna(0, ["n_children"]).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "counted")
    # the root is the parent of any number of nodes: its least member is one value, put in without a join on its key
    root = counted.filter("depth = 0").select("conv_id").first()
    up = counted.filter("n_children > 0 and depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("tag").alias("ptag"), F.col("conv_id").alias("up_conv"))
    placed = counted.join(up, ["depth", "pa", "pb", "ptag"], "left")
    placed = placed.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")).otherwise(F.col("up_conv")))
    out = placed.join(_subtrees(found, counted), KEY).join(_ends(found), KEY, "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

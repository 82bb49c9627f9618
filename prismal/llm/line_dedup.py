"""Fuzzy lines by MinHash: of each component of near-equal lines in the corpus one line stays.

A line (blanks collapsed, lower case, of `min_chars` characters at least; shorter ones are left alone, none but blank ones at 1) is the set of its
character shingles: `width` characters from every character on. A line of fewer than `width` characters is only equal to itself.
Signature: minima of the shingle hashes under 16 orders, each given by a multiplication. The orders form four groups of four, and a
band is any three of a group: at a similarity of 0.8 a pair meets with 1 - P(Bin(4, 0.8) < 3)^4 = 0.9989, at 0.85 with 0.9999,
however few its shingles. Lines that meet in a band are compared by bitmaps of their shingles first: bits that differ are shingles that
differ, so a pair with too many of them can't reach the threshold. The rest is verified by the exact Jaccard similarity. Links are
joined by distributed union-find (star contraction); the line that comes first (document id, text, position) stays, the others are removed.

Equal lines are one line from the start. The two or three lines that most bands hold are told by the band's sums, and compared. In larger bands the
lines outside the band's largest component are tried with one representative of the band, then with 8 and 32; after that, or as soon as it takes at most
`AFFORDABLE` pairs a line of the corpus, each of those with every line of the band that is in another component, so no link of a chain is left out. Representatives
and mixed bands are found by aggregates that are summed before they are dealt, and looked up by joins that Spark can split, so a band that
holds a third of all lines isn't gathered in a task. DataFrame functions only.

Defined results: null texts stay null; empty texts stay; a text may lose all its lines and is then empty (the row stays);
rows that repeat both an id and a text are one document and keep the same lines; a null id comes first; an empty table gives no row;
other columns are carried, but for those that have the names of the two counts, which are replaced.
"""

from __future__ import annotations

import functools
import itertools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm import common
from prismal.llm.common import drop_table, fresh, let, scratch, table
from prismal.llm.components import components

#: Odd numbers under 2^31: multiplied by one of them, modulo 2^32, hashes stand in another order.
FACTORS = [random.Random(k).getrandbits(30) << 1 | 1 for k in range(16)]
BANDS = tuple(band for k in range(0, 16, 4) for band in itertools.combinations(range(k, k + 4), 3))
LOW = 0xFFFFFFFF
#: Shingles hashed in one row, and bytes of a character.
STEP, WIDE = 16, 4
#: Representatives of a band in each round of tries.
REPS = (1, 8, 32)
#: After the first round of tries all pairs that are left are compared as soon as there are no more of them than this many a line of the corpus.
AFFORDABLE = 16
#: Bytes of removed lines that are broadcast to the documents at most.
BROADCAST = 32 << 20
#: Words of 64 bits in a line's bitmap, whose bits say whether an odd number of shingles has that place.
WORDS = 16

#: The small side of a join is broadcast up to 8 MB: this operator joins often, and the driver holds what it broadcasts until it is collected.
few = functools.partial(common.few, limit=8 << 20)


def collapsed(text: Column) -> Column:
    """Blanks within a line collapsed, of a whole text. The regular expression runs only where it can change something."""
    blanks = text.contains("  ")
    for c in "\t\x0b\f\r":
        blanks = blanks | text.contains(c)
    return F.when(blanks, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def characters(norm: Column) -> Column:
    """The characters as four bytes each, so that a shingle is cut out without reading what stands before it."""
    return F.encode(norm, "UTF-32")


def shingles(norm: Column, width: int) -> Column:
    """Distinct hashes of a normalised line's shingles, one from every character."""
    starts = F.sequence(F.lit(1), (F.length(norm) - width) * WIDE + 1, F.lit(WIDE))
    return F.array_distinct(let(characters(norm), lambda b: F.transform(starts, lambda at: F.xxhash64(F.substr(b, at, F.lit(width * WIDE))))))


def signatures(lines: DataFrame, width: int) -> DataFrame:
    """line and its minima m0, m1, ... (line, norm), of lines of `width` characters at least.

    Minima are aggregated over rows of a few shingles, so no array of hashes is made.
    """
    wide = lines.filter(F.length("norm") >= width).select("line", characters(F.col("norm")).alias("b"), ((F.length("norm") - width) * WIDE + 1).alias("last"))
    rows = wide.select("line", "b", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(STEP * WIDE))).alias("at"))
    starts = [F.least(F.col("at") + WIDE * k, F.col("last")) if k else F.col("at") for k in range(STEP)]
    hashed = rows.select("line", *(F.xxhash64(F.substr("b", at, F.lit(width * WIDE))).bitwiseAND(LOW).alias(f"x{k}") for k, at in enumerate(starts)))
    least = hashed.groupBy("line").agg(*(F.min(F.least(*((F.col(f"x{k}") * m).bitwiseAND(LOW) for k in range(STEP)))).alias(f"m{j}") for j, m in enumerate(FACTORS)))
    return least.select("line", *((F.col(f"m{j}") - (1 << 31)).cast("int").alias(f"m{j}") for j in range(len(FACTORS))))


def bitmaps(lines: DataFrame, width: int) -> DataFrame:
    """line, b0, b1, ... (WORDS words, each shingle's hash turning a bit over), size (number of distinct shingles) of distinct lines (line, norm)."""
    own = lines.repartition("line").select("line", F.explode(shingles(F.col("norm"), width)).alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))
    words = own.groupBy("line", F.pmod(F.shiftright("x", 6), F.lit(WORDS)).alias("w")).agg(F.bit_xor(bit).alias("bits"), F.count("*").alias("n"))
    parts = (F.bit_or(F.when(F.col("w") == w, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(WORDS))
    return words.groupBy("line").agg(F.sum("n").alias("size"), *parts)


def buckets(signed: DataFrame) -> DataFrame:
    """line, bucket: a row for each band."""
    return signed.select("line", F.explode(F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{j}") for j in band)) for b, band in enumerate(BANDS)))).alias("bucket"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_key, pos, norm, line (hash of norm) of the lines that take part."""
    # a column a step: within one expression the lower case of a text would be made for every look for a blank
    low = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    whole = low.select("doc_id", "text_key", collapsed(F.col("low")).alias("norm"))
    each = whole.select("doc_id", "text_key", F.posexplode(F.split("norm", "\n")).alias("pos", "raw"))
    return each.withColumn("norm", F.trim("raw")).filter(F.length("norm") >= min_chars).select("doc_id", "text_key", "pos", "norm", F.xxhash64("norm").alias("line"))


def _mixed(rest: DataFrame, comp: DataFrame) -> tuple[DataFrame, int]:
    """bucket, line, c (component), out (whether c is not the largest of the bucket) of the buckets whose lines are in more than one component, and
    how many pairs the lines outside would make with all of their bucket."""
    placed = rest.join(few(comp), F.col("line") == F.col("node"), "left").select("bucket", "line", F.coalesce("component", "line").alias("c"))
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("c", "n").alias("most"), F.max("n").alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = table(mixed.select("bucket", "most", (F.col("n") * (F.col("n") - F.col("top"))).alias("pairs")), "mixed-buckets")
    cost = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    return placed.join(few(mixed), "bucket").select("bucket", "line", "c", (F.col("c") != F.col("most")).alias("out")), cost


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links u, v: only components that a link joins, and lines new to comp, are contracted again."""
    held = few(comp)
    ends = links
    for end in ("u", "v"):
        at = held.select(F.col("node").alias("at"), "component")
        ends = ends.join(at, F.col(end) == F.col("at"), "left").withColumn(end, F.coalesce("component", end)).drop("at", "component")
    moved = few(table(components(ends), "moved"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = comp.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return kept.union(moved.join(held, "node", "left_anti").select("node", "component"))


def linked(lines: DataFrame, width: int, threshold: float) -> DataFrame:
    """node, component of every line of lines (line, norm) that has a link; a line may stand in many rows."""
    signed = table(signatures(lines, width), "signatures")
    keys = buckets(signed)
    met = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.bit_xor("line").alias("all")).filter("n > 1")
    met = table(met, "shared-buckets")
    # two or three lines of a bucket are told by its sums, so only the larger buckets' lines are looked up
    mid = F.col("low").bitwiseXOR(F.col("high")).bitwiseXOR(F.col("all"))
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    two = F.array(pair(F.col("low"), F.col("high")))
    three = F.array(pair(F.col("low"), F.col("high")), pair(F.col("low"), mid), pair(mid, F.col("high")))
    tried = table(met.filter("n <= 3").select(F.inline(F.when(F.col("n") == 2, two).otherwise(three))).distinct(), "pairs")
    # lines that are near share several bands: of the buckets that hold the same lines, told by the sums, one is looked up
    large = table(met.filter("n > 3").groupBy("n", "low", "high", "all").agg(F.min("bucket").alias("bucket")).select("bucket"), "large-buckets")
    rest = table(keys.join(few(large), "bucket", "left_semi"), "buckets")
    wanted = table(rest.select("line").union(tried.select("u")).union(tried.select("v")).distinct(), "wanted")
    texts = table(lines.join(few(wanted), "line", "left_semi").groupBy("line").agg(F.first("norm").alias("norm")), "texts")
    n_lines = signed.count()
    for t in (signed, met, large, wanted):
        drop_table(t)

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of a table of pairs whose similarity reaches the threshold. Texts travel, those of the pairs alone, which are shorter than their shingles."""
        held = few(pairs)
        nu, nv = (texts.select(F.col("line").alias(x), F.col("norm").alias(f"n{x}")).join(held.select(x), x, "left_semi") for x in ("u", "v"))
        both = pairs.join(nu, "u").join(nv, "v")
        sets = F.array(F.struct(shingles(F.col("nu"), width).alias("a"), shingles(F.col("nv"), width).alias("b")))
        shared = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("n"), (F.size(s["a"]) + F.size(s["b"])).alias("total")))
        reached = F.exists(shared, lambda s: s["n"] >= threshold * (s["total"] - s["n"]))
        return table(both.filter(reached).select("u", "v"), "links")

    comp = table(components(verify(tried)), "components")
    if rest.isEmpty():
        return comp
    inside = table(rest.select("line").distinct(), "inside")
    sketch = table(bitmaps(texts.join(few(inside), "line", "left_semi"), width), "bitmaps")
    drop_table(inside)

    def room(x: str, y: str) -> Column:
        differ = sum((F.bit_count(F.col(f"{x}.b{w}").bitwiseXOR(F.col(f"{y}.b{w}"))) for w in range(1, WORDS)), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
        # sizes first, which settle most pairs: as many shingles differ as the sizes do
        a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
        sizes = (a >= threshold * b - 1e-6) & (b >= threshold * a - 1e-6)
        return sizes & ((1 + threshold) * differ <= (1 - threshold) * (a + b) + 1e-6)

    def apart(x: DataFrame, y: DataFrame, reps: int | None) -> DataFrame:
        """Pairs of x and y (bucket, line, c, out) that share a bucket, stand in different components and have room for the threshold."""
        near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c"))
        pair = [F.least("x.line", "y.line").alias("u"), F.greatest("x.line", "y.line").alias("v")]
        if reps == 1:  # a row has one partner: pairs are fewer than rows
            met = x.alias("x").join(y.alias("y"), near).select(*pair).distinct()
            return met.join(few(sketch).alias("x"), F.col("x.line") == F.col("u")).join(few(sketch).alias("y"), F.col("y.line") == F.col("v")).filter(room("x", "y")).select("u", "v")
        if not reps:  # all pairs of a bucket, from one side
            near = near & (~F.col("y.out") | (F.col("x.line") < F.col("y.line")))
        x, y = (z.join(few(sketch), "line") for z in (x, y))
        return x.alias("x").join(y.alias("y"), near & room("x", "y")).select(*pair).distinct()

    for turn, reps in enumerate((*REPS, None)):
        found, cost = _mixed(rest, comp)
        if not cost:
            break
        mixed = table(found, "mixed")
        if turn and cost <= AFFORDABLE * n_lines:
            reps = None
        chosen = mixed
        if reps:
            # the least line of each of `reps` parts of a bucket, under an order of this turn
            salt, part = F.xxhash64(F.lit(turn)), F.pmod(F.xxhash64("line", F.lit(turn)), F.lit(reps))
            chosen = mixed.groupBy("bucket", part.alias("part")).agg(F.min(F.col("line").bitwiseXOR(salt)).alias("m"))
            chosen = chosen.select("bucket", F.col("m").bitwiseXOR(salt).alias("line")).join(mixed, ["bucket", "line"])
        pairs = table(apart(mixed.filter("out"), chosen, reps).join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        drop_table(mixed)
        new = verify(pairs)
        if not new.isEmpty():
            comp = table(_joined(comp, new), "components")
        if not reps:
            break
    return comp


def duplicates(docs: DataFrame, width: int = 12, threshold: float = 0.8, min_chars: int = 20) -> DataFrame:
    """doc_id, text_key and gone (positions of the lines to remove)."""
    lines = table(_lines(docs, min_chars), "lines")
    comp = linked(lines.select("line", "norm"), width, threshold)
    placed = lines.join(few(comp), F.col("line") == F.col("node"), "left").select("doc_id", "text_key", "pos", F.coalesce("component", "line").alias("c"))
    again = table(placed.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c"), "repeated-lines")
    several = placed.join(few(again), "c", "left_semi")
    here = F.struct("doc_id", "text_key", "pos")
    first = several.groupBy("c").agg(F.min(here).alias("first"))
    gone = several.join(few(table(first, "first-lines")), "c").filter(~here.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame, width: int = 12, threshold: float = 0.8, min_chars: int = 20, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with their texts rid of repeated lines; all columns and two more, the counts of lines before and of those removed."""
    i, k, g = fresh(docs, "_id", "_key", "_gone")
    with scratch(docs.sparkSession) as keep:
        found = keep(table(duplicates(docs, width, threshold, min_chars), "gone"))
    found = found.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("gone").alias(g))
    same = docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(k))
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, at: ~F.array_contains(F.col(g), at)), "\n")
    counts = {n_lines: F.coalesce(F.size(parts), F.lit(0)).cast("long"), n_removed: F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long")}
    columns = [F.when(F.col(g).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
    # removed lines are few numbers a document: up to 32 MB of them are broadcast, so that whole texts needn't be dealt
    size = found.agg(F.coalesce(F.sum(F.size(g) * 4 + 64), F.lit(0))).first()[0]
    return docs.join(F.broadcast(found) if size <= BROADCAST else found, same, "left").select(*columns, *(v.alias(c) for c, v in counts.items()))

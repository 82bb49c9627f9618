"""Alias tables of normalised histograms, made by folds over small arrays inside one expression per histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BITS, SIZE_BITS = 12, 8


def normalized(hist: DataFrame, *key: str, bits: int = RANGE_BITS) -> DataFrame:
    """key, dist: the counts of a histogram's symbols in order, scaled to a sum of 2^bits, one at least; the largest (the first of equals) takes the rest."""
    total = hist.groupBy(*key).agg(F.sum("n").alias("t"))
    scaled = hist.join(total, list(key)).withColumn("f", F.greatest(F.floor(F.col("n") * (1 << bits) / F.col("t")), F.lit(1)).cast("long"))
    line = scaled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("sym", "n", "f"))).alias("s"))
    most = F.array_position(F.transform("s", lambda x: x["n"]), F.array_max(F.transform("s", lambda x: x["n"])))
    rest = F.lit(1 << bits) - F.aggregate(F.transform("s", lambda x: x["f"]), F.lit(0).cast("long"), lambda a, x: a + x)
    dist = F.transform("s", lambda x, i: x["f"] + F.when(i + 1 == F.col("most"), F.col("rest")).otherwise(0))
    return line.withColumn("most", most).withColumn("rest", rest).select(*key, dist.alias("dist"))


def _let(value: Column, body) -> Column:
    """body(v) with v bound once, so that inner expressions don't evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _put(a: Column, at: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def _longs(a: Column) -> Column:
    return a.cast("array<long>")


def table(dist: Column, range_bits: int = RANGE_BITS, size_bits: int = SIZE_BITS) -> Column:
    """Entries (cutoff, right, offset, freq0, freq1_xor_freq0) of a distribution with a sum of 2^range_bits and 2^size_bits symbols at most; null for others.

    What is over the size of an entry is given to those under it: each step takes the last of either stack, and the taker keeps its place
    or changes stacks. A step settles one entry, so 2^size_bits steps do.
    """
    return _let(dist, lambda d: _table(d, range_bits, size_bits))


def _table(dist: Column, range_bits: int, size_bits: int) -> Column:
    size, whole = 1 << size_bits, 1 << range_bits
    room = whole >> size_bits
    places = F.sequence(F.lit(0), F.lit(size - 1))
    start = _longs(F.transform(places, lambda i: F.coalesce(F.get(dist, i), F.lit(0))))
    zeros = _longs(F.array_repeat(F.lit(0), size))
    listed = lambda test: _longs(F.filter(places, lambda i: test(F.coalesce(F.get(dist, i), F.lit(0)))))
    state = F.struct(start.alias("cut"), listed(lambda c: c < room).alias("under"), listed(lambda c: c > room).alias("over"), zeros.alias("right"), zeros.alias("offset"))

    def step(s: Column, _: Column) -> Column:
        giver, taker = F.element_at(s["over"], -1), F.element_at(s["under"], -1)
        left = F.get(s["cut"], giver.cast("int")) - (room - F.get(s["cut"], taker.cast("int")))
        return F.when(F.size(s["over"]) == 0, s).otherwise(_let(F.struct(giver.alias("giver"), taker.alias("taker"), left.alias("left")), lambda b: given(s, b["giver"], b["taker"], b["left"])))

    def given(s: Column, giver: Column, taker: Column, left: Column) -> Column:
        shorter = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        none = F.array().cast("array<long>")
        return F.struct(
            _put(s["cut"], giver, left).alias("cut"),
            F.concat(shorter(s["under"]), F.when(left < room, F.array(giver)).otherwise(none)).alias("under"),
            F.concat(shorter(s["over"]), F.when(left > room, F.array(giver)).otherwise(none)).alias("over"),
            _put(s["right"], taker, giver).alias("right"),
            _put(s["offset"], taker, left).alias("offset"),
        )

    settled = F.aggregate(F.sequence(F.lit(1), F.lit(size)), state, step)
    freq = lambda i: F.coalesce(F.get(dist, i.cast("int")), F.lit(0)).cast("long")

    def entries(s: Column) -> Column:
        def one(i: Column) -> Column:
            cut = F.get(s["cut"], i)
            full = cut == room
            right = F.when(full, i.cast("long")).otherwise(F.get(s["right"], i))
            offset = F.when(full, F.lit(0).cast("long")).otherwise(F.get(s["offset"], i) - cut)
            return _let(right, lambda r: F.struct(F.when(full, F.lit(0).cast("long")).otherwise(cut).alias("cutoff"), r.alias("right"), offset.alias("offset"), freq(i).alias("freq0"), freq(i).bitwiseXOR(freq(r)).alias("freq1_xor_freq0")))

        return F.transform(places, one)

    sole = F.array_position(dist, whole) - 1
    alone = F.transform(places, lambda i: F.struct(F.lit(0).cast("long").alias("cutoff"), sole.alias("right"), (F.lit(room) * i).cast("long").alias("offset"), F.lit(0).cast("long").alias("freq0"), F.lit(whole).cast("long").alias("freq1_xor_freq0")))
    total = F.aggregate(dist, F.lit(0).cast("long"), lambda a, x: a + x)
    found = _let(settled, entries)
    return F.when((total == whole) & (F.size(dist) <= size), F.when(F.array_contains(dist, F.lit(whole).cast("long")), alone).otherwise(found))


def lookup(entries: Column, value: Column, range_bits: int = RANGE_BITS, size_bits: int = SIZE_BITS) -> Column:
    """(symbol, offset, freq) of a value under 2^range_bits."""
    bits = range_bits - size_bits
    i = F.shiftright(value, bits).cast("int")
    pos = value.bitwiseAND(F.lit((1 << bits) - 1))
    e = F.get(entries, i)
    over = pos >= e["cutoff"]
    return F.struct(
        F.when(over, e["right"]).otherwise(i.cast("long")).alias("symbol"),
        (F.when(over, e["offset"]).otherwise(F.lit(0)) + pos).alias("offset"),
        e["freq0"].bitwiseXOR(F.when(over, e["freq1_xor_freq0"]).otherwise(F.lit(0).cast("long"))).alias("freq"),
    )

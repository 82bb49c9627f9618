"""Clusters of histograms (ctx, sym, n): centres farthest from each other, then merges that lower the cost of coding.

With f(n) = n log2 n, joining histograms a and b costs f(A + B) - f(A) - f(B) - sum over common symbols of (f(a + b) - f(a) - f(b))
bits, so distances are sums over an inner join by symbol. The driver holds the number of centres and the name of the newest; distances, assignments
and histograms stay tables. Merges go in rounds: every two clusters that are each other's cheapest partner are joined at
once, and only costs that concern a joined cluster are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.tables import forget, written

#: Bits under which a histogram is no centre of its own.
DISTINCT = 48.0
#: Bits of the table of normalised counts.
TABLE_BITS = 12


def f(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def distances(hist: DataFrame, centres: DataFrame) -> DataFrame:
    """ctx, centre, distance of every histogram to every centre (ctx, sym, n: as many as there are centres), rounded to 1e-6."""
    listed = F.array(*(F.struct(F.lit(r.ctx).alias("centre"), F.lit(r.u).alias("u")) for r in centres.groupBy("ctx").agg(F.sum("n").alias("u")).collect()))
    side = centres.select(F.col("ctx").alias("centre"), "sym", F.col("n").alias("m"))
    common = hist.join(side, "sym").groupBy("ctx", "centre").agg(F.sum(f(F.col("n") + F.col("m")) - f(F.col("n")) - f(F.col("m"))).alias("saved"))
    every = hist.groupBy("ctx").agg(F.sum("n").alias("t")).select("ctx", "t", F.explode(listed).alias("c")).select("ctx", "t", "c.*")
    found = every.join(common, ["ctx", "centre"], "left")
    cost = f(F.col("t") + F.col("u")) - f(F.col("t")) - f(F.col("u")) - F.coalesce("saved", F.lit(0.0))
    return found.select("ctx", "centre", F.round(cost, 6).alias("distance"))


def centres(hist: DataFrame, k: int, distinct: float = DISTINCT) -> DataFrame:
    """ctx, place of at most k centres: the largest histogram, then each time the one farthest from all centres so far."""
    total = hist.groupBy("ctx").agg(F.sum("n").alias("t"))
    first = total.orderBy(F.desc("t"), "ctx").select("ctx").first()
    names = [first.ctx] if first else []
    near = None
    while 0 < len(names) < k:
        new = distances(hist, hist.filter(F.col("ctx") == names[-1])).select("ctx", "distance")
        if near is not None:
            new = new.join(near.withColumnRenamed("distance", "d"), "ctx").select("ctx", F.least("distance", "d").alias("distance"))
        now = written(new.withColumn("distance", F.when(F.col("ctx").isin(names), 0.0).otherwise(F.col("distance"))), "distances")
        if near is not None:
            forget(near)
        near = now
        far = near.orderBy(F.desc("distance"), "ctx").first()
        if far.distance < distinct or far.distance == 0:
            break
        names.append(far.ctx)
    if near is not None:
        forget(near)
    return hist.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names)], "ctx string, place long")


def fast(hist: DataFrame, k: int, distinct: float = DISTINCT) -> DataFrame:
    """ctx, cluster: each histogram under the nearest of at most k centres. hist is worked out once."""
    hist = written(hist, "histograms")
    assigned = written(_nearest(hist, k, distinct), "assigned")
    forget(hist)
    return assigned


def _nearest(hist: DataFrame, k: int, distinct: float) -> DataFrame:
    found = centres(hist, k, distinct)
    far = distances(hist, hist.join(F.broadcast(found), "ctx").select(F.col("place").cast("string").alias("ctx"), "sym", "n"))
    own = far.join(F.broadcast(found), "ctx", "left").withColumn("distance", F.when(F.col("place") == F.col("centre").cast("long"), F.lit(-1.0)).otherwise(F.col("distance")))
    return own.groupBy("ctx").agg(F.min(F.struct("distance", F.col("centre").cast("long").alias("c"))).alias("m")).select("ctx", F.col("m.c").alias("cluster"))


def population_cost(hist: DataFrame, *key: str) -> DataFrame:
    """Bits of coding a histogram's symbols and its table: five bits a used symbol and those of its count out of 2^TABLE_BITS."""
    total = hist.groupBy(*key).agg(F.sum("n").alias("t"))
    share = F.greatest(F.floor(F.col("n") * (1 << TABLE_BITS) / F.col("t")), F.lit(1))
    bits = F.col("n") * F.log2(F.col("t") / F.col("n")) + 5 + F.floor(F.log2(share))
    return hist.join(total, list(key)).groupBy(*key).agg(F.round(F.sum(bits), 6).alias("cost"))


def _gains(pairs: DataFrame, hist: DataFrame, costs: DataFrame) -> DataFrame:
    """a, b, gain (negative: joining saves bits) of the pairs of clusters that there are."""
    known = costs.select(F.col("cluster"))
    pairs = pairs.join(known.withColumnRenamed("cluster", "a"), "a", "left_semi").join(known.withColumnRenamed("cluster", "b"), "b", "left_semi")
    one = lambda c: pairs.join(hist.withColumnRenamed("cluster", c), c).select("a", "b", "sym", "n")
    joint = population_cost(one("a").union(one("b")).groupBy("a", "b", "sym").agg(F.sum("n").alias("n")), "a", "b")
    side = lambda c: costs.select(F.col("cluster").alias(c), F.col("cost").alias(f"cost_{c}"))
    gain = F.round(F.col("cost") - F.col("cost_a") - F.col("cost_b"), 6)
    return joint.join(side("a"), "a").join(side("b"), "b").select("a", "b", gain.alias("gain")).filter("gain < 0")


def best(hist: DataFrame, k: int, distinct: float = DISTINCT) -> DataFrame:
    """ctx, cluster: fast(), then merges of clusters while they lower the total cost; clusters are named by their least member's place."""
    hist = written(hist, "histograms")
    assigned = written(_nearest(hist, k, distinct), "assigned")
    held = written(hist.join(assigned, "ctx").groupBy("cluster", "sym").agg(F.sum("n").alias("n")), "cluster-histograms")
    forget(hist)
    names = held.select("cluster").distinct()
    last = F.lit(k - 1).cast("long")
    pairs = names.filter(F.col("cluster") < last).select(F.col("cluster").alias("a"), F.explode(F.sequence(F.col("cluster") + 1, last)).alias("b"))  # k (k - 1) / 2 at most
    gains = written(_gains(pairs, held, population_cost(held, "cluster")), "gains")
    while True:
        ends = gains.select("a", "b", "gain", F.explode(F.array("a", "b")).alias("end"))
        cheapest = ends.groupBy("end").agg(F.min(F.struct("gain", "a", "b")).alias("m")).select("m.*")
        merged = written(cheapest.groupBy("a", "b").agg(F.count("*").alias("ends")).filter("ends = 2").select("a", "b"), "merges")
        if merged.isEmpty():
            forget(merged, gains, held)
            return assigned
        into = F.broadcast(merged.select(F.col("b").alias("cluster"), F.col("a").alias("into")))
        moved = lambda df: df.join(into, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("into")  # noqa: E731, B023
        now_assigned = written(moved(assigned).select("ctx", "cluster"), "assigned")
        now_held = written(moved(held).groupBy("cluster", "sym").agg(F.sum("n").alias("n")), "cluster-histograms")
        touched = merged.select(F.explode(F.array("a", "b")).alias("x"))
        kept = gains.join(F.broadcast(touched.withColumnRenamed("x", "a")), "a", "left_anti").join(F.broadcast(touched.withColumnRenamed("x", "b")), "b", "left_anti").select("a", "b", "gain")
        grown = merged.select(F.col("a").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("y")).filter("x <> y")
        fresh = grown.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now_gains = written(kept.union(_gains(fresh, now_held, population_cost(now_held, "cluster"))), "gains")
        forget(merged, gains, held, assigned)
        assigned, held, gains = now_assigned, now_held, now_gains

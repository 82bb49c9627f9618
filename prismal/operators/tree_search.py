"""Search of decision trees over sample properties: at every node the test and the two predictors whose tokens cost the fewest bits.

Samples are rows of quantised properties and, for each predictor, the token and the number of raw bits of its residual. A level of the tree is one
pass: counts by (node, property, value, predictor, token) are summed before they are dealt, and what is left is bounded by the
alphabets, not by the samples. Both sides of every threshold are then running sums over the values of a property. With f(n) = n log2 n the
entropy of a side is f(total) - sum f(count), of which each value changes only the counts of its own tokens, so nothing is made dense.
Samples learn their new node from a table of splits, at most 2^level rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators.trees import Node
from prismal.tables import forget, written

#: Bits that a change of predictor has to save: PENALTY / (100 + threshold).
PENALTY = 800.0


def chunk_tops(samples: DataFrame, properties: list[str], chunks: int) -> dict[str, list[int]]:
    """The greatest value of each of `chunks` parts of about equal count of a property; properties x chunks numbers at most."""
    each = samples.select(F.explode(F.create_map(*(x for p in properties for x in (F.lit(p), F.col(p))))).alias("prop", "value"))
    counts = each.groupBy("prop", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("prop")
    before = F.coalesce(F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor(before * chunks / F.sum("n").over(w))
    tops = counts.withColumn("part", part).groupBy("prop", "part").agg(F.max("value").alias("top")).collect()
    return {p: sorted(r.top for r in tops if r.prop == p) for p in properties}


def quantized(value: Column, tops: list[int]) -> Column:
    """The top of the part that a value lies in."""
    return F.array_min(F.filter(F.array(*(F.lit(t).cast("long") for t in tops)), lambda t: t >= value))


def _f(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _level(samples: DataFrame, nodes: DataFrame, properties: list[str], predictors: list[str], threshold: float) -> DataFrame:
    """Per node that is worth it: prop, value, more and other (the predictors above the value and up to it), bits before and after."""
    props = F.array(*(F.struct(F.lit(k).alias("prop"), F.col(p).alias("value")) for k, p in enumerate(properties)))
    tokens = F.array(*(F.struct(F.lit(k).alias("pred"), F.col(f"{p}_token").alias("token"), F.col(f"{p}_bits").alias("bits")) for k, p in enumerate(predictors)))
    long = samples.select("node", "n", F.explode(props).alias("p"), tokens.alias("t")).select("node", "n", "p.*", F.explode("t").alias("t")).select("node", "n", "prop", "value", "t.*")
    counts = long.groupBy("node", "prop", "value", "pred", "token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bits")).alias("raw"))
    token = Window.partitionBy("node", "prop", "pred", "token")
    upto = F.sum("n").over(token.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(token))
    below = _f(F.col("upto")) - _f(F.col("upto") - F.col("n"))
    above = _f(F.col("all") - F.col("upto")) - _f(F.col("all") - F.col("upto") + F.col("n"))
    values = placed.groupBy("node", "prop", "pred", "value").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum(below).alias("below"), F.sum(above).alias("above"))
    whole = Window.partitionBy("node", "prop", "pred")
    running = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = values.select("node", "prop", "pred", "value", *(F.sum(c).over(running).alias(c) for c in ("n", "raw", "below", "above")), F.sum("n").over(whole).alias("all_n"), F.sum("raw").over(whole).alias("all_raw"), F.sum("below").over(whole).alias("all_f"))
    other = _f(F.col("n")) - F.col("below") + F.col("raw")
    more = _f(F.col("all_n") - F.col("n")) - (F.col("all_f") + F.col("above")) + F.col("all_raw") - F.col("raw")
    sides = sums.join(F.broadcast(nodes.select("node", "predictor")), "node").withColumn("other", other).withColumn("more", more)
    base = sides.filter((F.col("prop") == 0) & (F.col("pred") == F.col("predictor"))).groupBy("node").agg(F.max(_f(F.col("all_n")) - F.col("all_f") + F.col("all_raw")).alias("bits"))
    penalty = F.when(F.col("pred") != F.col("predictor"), PENALTY / (100 + threshold)).otherwise(0.0)
    side = lambda c: F.min(F.struct(F.round(F.col(c) + penalty, 6).alias("k"), F.col("pred"), F.col(c).alias("cost"))).alias(c)
    each = sides.filter("n < all_n").groupBy("node", "prop", "value").agg(side("other"), side("more"))
    cost = F.col("other.cost") + F.col("more.cost")
    best = each.groupBy("node").agg(F.min(F.struct(F.round(cost, 6).alias("cost"), "prop", "value", F.col("more.pred").alias("more"), F.col("other.pred").alias("other"))).alias("b"))
    return best.join(base, "node").filter(F.col("b.cost") + threshold < F.col("bits")).select("node", "b.prop", "b.value", "b.more", "b.other", "bits", "b.cost")


def search(samples: DataFrame, properties: list[str], predictors: list[str], threshold: float = 120.0, levels: int = 5) -> DataFrame:
    """Nodes of the tree: node (root 1, children 2 node and 2 node + 1), predictor, n (samples), and for tests prop, value, bits and cost.

    samples: the properties, and <predictor>_token and <predictor>_bits for each predictor. Samples above a test's value go to 2 node. The
    first predictor is that of the root.
    """
    keys = [*properties, *(f"{p}_{x}" for p in predictors for x in ("token", "bits"))]
    now = written(samples.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("node", F.lit(1).cast("long")), "tree-samples")
    frontier = samples.sparkSession.createDataFrame([(1, 0)], "node long, predictor int")
    made, tests, used = [frontier], [], [now]
    for _ in range(levels):
        found = written(_level(now, frontier, properties, predictors, threshold), "tree-level")
        used.append(found)
        if found.isEmpty():
            break
        tests.append(found)
        child = lambda k, c: found.select((2 * F.col("node") + k).alias("node"), F.col(c).alias("predictor"))  # noqa: E731, B023
        frontier = child(0, "more").union(child(1, "other"))
        made.append(frontier)
        value = F.element_at(F.array(*(F.col(p) for p in properties)), F.col("prop") + 1)
        now = written(now.join(F.broadcast(found.select("node", "prop", "value")), "node").withColumn("node", 2 * F.col("node") + F.when(value > F.col("value"), 0).otherwise(1)).select(*keys, "n", "node"), "tree-samples")
        used.append(now)
    every = reduce(DataFrame.union, made)
    empty = samples.sparkSession.createDataFrame([], "node long, prop int, value long, more int, other int, bits double, cost double")
    cut = reduce(DataFrame.union, tests, empty).select("node", "prop", "value", "bits", "cost")
    name = lambda c, names: F.when(F.col(c).isNotNull(), F.element_at(F.array(*(F.lit(x) for x in names)), F.coalesce(F.col(c), F.lit(0)) + 1)).alias(c)
    out = written(every.join(cut, "node", "left").select("node", name("predictor", predictors), name("prop", properties), "value", "bits", "cost"), "tree")
    forget(*used)
    return out


def tree_of(nodes: DataFrame) -> Node:
    """The tree that search() found, for trees.compile_case; 2^(levels + 1) nodes at most."""
    rows = {r.node: r for r in nodes.collect()}

    def at(k: int) -> Node:
        r = rows[k]
        return Node(predictor=r.predictor) if r.prop is None else Node(r.prop, r.value, at(2 * k), at(2 * k + 1))

    return at(1)

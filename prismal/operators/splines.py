"""Splines: curves through control points, sampled at equal arc length and painted as Gaussian brush marks.

A curve is a row a control point. Spans between neighbouring points become centripetal Catmull-Rom pieces (a lag and a lead give the four
points of a span); arc length is a running sum over the samples of a curve, and the marks at whole steps of it are found in the piece
that crosses them, so a curve is a window over its samples and not a loop. A mark's reach is bounded by its width; each task sums
the samples inside the squares of its marks, a few hundred thousand at once, and only these sums are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: points of a span, distance of marks, terms of a colour's series, what a mark may still add at its border (a power), and the
# approximation of the error function, 1 - 1 / p(x)^4.
SPAN, STEP, TERMS, LEAST, POWER = 16, 1.0, 32, 0.1, 3
#: Samples under marks that are worked out at once.
CHUNK = 1 << 18
ERF = (1.0, 0.277820801, 0.232120216, 0.000205260015, 0.0777394369)


def distinct(points: DataFrame) -> DataFrame:
    """The points without those that repeat the one before; k from 0 on."""
    w = Window.partitionBy("curve").orderBy("k")
    fresh = F.lag("x").over(w).isNull() | (F.lag("x").over(w) != F.col("x")) | (F.lag("y").over(w) != F.col("y"))
    kept = points.select("curve", "k", "x", "y").withColumn("fresh", fresh).filter("fresh")
    return kept.select("curve", (F.row_number().over(w) - 1).cast("long").alias("k"), "x", "y")


def spans(points: DataFrame) -> DataFrame:
    """curve, span, ends (whether it is the last), and x, y of four points p0 .. p3 of each span from p1 to p2; beyond its ends a curve goes on as it came. points: curve, k, x, y."""
    w = Window.partitionBy("curve").orderBy("k")
    near = distinct(points)
    for c in "xy":
        near = near.withColumn(f"{c}_1", F.lag(c).over(w)).withColumn(f"{c}2", F.lead(c).over(w)).withColumn(f"{c}3", F.lead(c, 2).over(w))
    near = near.filter("x2 is not null")
    pick = []
    for c in "xy":
        p1, p2 = F.col(c), F.col(f"{c}2")
        pick += [F.coalesce(f"{c}_1", p1 + (p1 - p2)).alias(f"{c}0"), p1.alias(f"{c}1"), p2.alias(f"{c}2"), F.coalesce(f"{c}3", p2 + (p2 - p1)).alias(f"{c}3")]
    return near.select("curve", F.col("k").alias("span"), F.col("x3").isNull().alias("ends"), *(x.cast("double") for x in pick))


def _mix(a: Column, b: Column, ta: Column, tb: Column, t: Column) -> Column:
    return a + (b - a) * ((t - ta) / (tb - ta))


def samples(points: DataFrame) -> DataFrame:
    """curve, place, x, y: SPAN samples of each span and the last point."""
    s = spans(points)
    for k in range(3):
        far = F.pow(F.pow(F.col(f"x{k + 1}") - F.col(f"x{k}"), 2) + F.pow(F.col(f"y{k + 1}") - F.col(f"y{k}"), 2), 0.25)
        s = s.withColumn(f"d{k}", far)
    s = s.withColumn("t1", F.col("d0")).withColumn("t2", F.col("d0") + F.col("d1")).withColumn("t3", F.col("d0") + F.col("d1") + F.col("d2"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SPAN - 1) + F.col("ends").cast("int")))).withColumn("t", F.col("t1") + F.col("d1") * F.col("i") / SPAN)
    t0, t1, t2, t3, t = F.lit(0.0), *(F.col(c) for c in ("t1", "t2", "t3", "t"))

    def at(c: str) -> Column:
        p0, p1, p2, p3 = (F.col(f"{c}{k}") for k in range(4))
        a1, a2, a3 = _mix(p0, p1, t0, t1, t), _mix(p1, p2, t1, t2, t), _mix(p2, p3, t2, t3, t)
        return _mix(_mix(a1, a2, t0, t2, t), _mix(a2, a3, t1, t3, t), t1, t2, t)

    value = lambda c: F.when(F.col("i") == 0, F.col(f"{c}1")).when(F.col("i") == SPAN, F.col(f"{c}2")).otherwise(at(c)).alias(c)
    return s.select("curve", (F.col("span") * SPAN + F.col("i")).alias("place"), value("x"), value("y"))


def marks(points: DataFrame, step: float = STEP) -> DataFrame:
    """curve, mark, x, y, part, length: points at equal arc length; part is the share of a step that a mark stands for, and length that of the curve.

    The last mark is the end of the curve, with what is left of a step.
    """
    w = Window.partitionBy("curve").orderBy("place")
    s = samples(points).withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w))
    s = s.withColumn("own", F.when(F.col("bx").isNotNull(), F.sqrt(F.pow(F.col("bx") - F.col("x"), 2) + F.pow(F.col("by") - F.col("y"), 2))).otherwise(0.0))
    s = s.withColumn("upto", F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("length", F.sum("own").over(Window.partitionBy("curve")))
    s = s.withColumn("from", F.col("upto") - F.col("own"))
    # whole steps inside (from, upto]; the first sample also holds the mark at 0
    low, high = F.floor(F.col("from") / step) + 1, F.floor(F.col("upto") / step)
    first = F.when(F.col("place") == 0, F.lit(0)).otherwise(low)
    numbers = F.when(F.col("bx").isNull(), F.array(F.floor(F.col("length") / step).cast("long") + 1)).when(first <= high, F.sequence(first.cast("long"), high.cast("long")))
    each = s.withColumn("mark", F.explode(numbers))
    share = F.when(F.col("bx").isNull(), 0.0).when(F.col("own") > 0, (F.col("mark") * step - F.col("from")) / F.col("own")).otherwise(0.0)
    along = lambda c: (F.col(c) + (F.coalesce(f"b{c}", c) - F.col(c)) * share).alias(c)
    part = F.when(F.col("bx").isNull(), F.col("length") - (F.col("mark") - 1) * step).otherwise(F.lit(float(step)))
    return each.select("curve", "mark", along("x"), along("y"), part.alias("part"), "length").filter("part > 0")


def series(terms: Column, t: Column) -> Column:
    """Value at t (0 to TERMS - 1) of a cosine series given by its terms."""
    return F.aggregate(F.transform(terms, lambda a, k: a * F.cos((k * math.pi / TERMS) * (t + 0.5))), F.lit(0.0), lambda a, x: a + x) * math.sqrt(2.0)


def brushes(found: DataFrame, strokes: DataFrame, step: float = STEP) -> DataFrame:
    """x, y, sigma, reach, c0, c1, c2 of each mark. strokes: curve, and arrays of terms color0, color1, color2, sigma."""
    along = F.least(F.lit(1.0), F.col("mark") * step / F.greatest(F.col("length"), F.lit(1e-12)))
    t = along * (TERMS - 1)
    each = found.join(strokes, "curve").select("x", "y", series(F.col("sigma"), t).alias("sigma"), *((series(F.col(f"color{k}"), t) * F.col("part")).alias(f"c{k}") for k in range(3)))
    most = F.greatest(*(F.abs(f"c{k}") for k in range(3)))
    bound = -2 * F.col("sigma") * F.col("sigma") * (POWER * math.log(LEAST) - F.log(F.greatest(most, F.lit(0.01))))
    return each.filter("sigma <> 0").withColumn("reach", F.sqrt(F.greatest(F.lit(0.0), bound)))


def _erf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    p = np.zeros_like(a)
    for c in reversed(ERF):
        p = p * a + c
    p *= p
    return np.copysign(1 - 1 / (p * p), x)


def painted(x: np.ndarray, y: np.ndarray, brush: dict) -> np.ndarray:
    """Weight of a mark at samples: its bell over a sample's square by the distance of their middles, inside the square of its reach."""
    d, sigma, reach = np.hypot(x - brush["x"], y - brush["y"]), brush["sigma"], brush["reach"]
    one = _erf((0.5 * d + math.sqrt(0.125)) / sigma) - _erf((0.5 * d - math.sqrt(0.125)) / sigma)
    inside = np.ones(d.shape, bool)
    for c, k in ((x, "x"), (y, "y")):
        inside &= (c >= math.floor(brush[k] - reach + 0.5)) & (c <= math.floor(brush[k] + reach + 0.5))
    return np.where(inside, one * one * 0.25 * sigma, 0.0)


def _paint(batches: Iterator[pa.RecordBatch], tile: int, width: int, height: int, held: int) -> Iterator[pa.RecordBatch]:
    """Sums of the marks of a task, which meet only the samples inside their reach; about `held` tiles are kept, then given out."""
    slots: dict[tuple[int, int], int] = {}
    canvas = np.zeros((3, 0))

    def done() -> pa.RecordBatch:
        at = np.array(list(slots), "i8")
        on = np.nonzero(np.any(canvas[:, : len(slots) * tile * tile] != 0, axis=0))[0]
        slot, y, x = on // (tile * tile), on // tile % tile, on % tile
        return pa.RecordBatch.from_arrays([pa.array(at[slot, 0] * tile + y), pa.array(at[slot, 1] * tile + x), *(pa.array(c[on]) for c in canvas)], ["y", "x", "v0", "v1", "v2"])

    for b in batches:
        mark = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(("x", "y", "sigma", "reach", "c0", "c1", "c2"))}
        first = {n: np.maximum(0, np.floor(mark[n] - mark["reach"] + 0.5)).astype("i8") for n in "xy"}
        count = {n: np.maximum(0, np.minimum(most, np.floor(mark[n] + mark["reach"] + 0.5).astype("i8") + 1) - first[n]) for n, most in (("x", width), ("y", height))}
        lines = np.repeat(np.arange(len(mark["x"])), np.where(count["x"] > 0, count["y"], 0))
        row = first["y"][lines] + _places(lines)
        ends = np.cumsum(count["x"][lines])
        begin = 0
        while begin < len(lines):  # lines of samples, about CHUNK samples at a time
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
            line = np.repeat(np.arange(begin, end), count["x"][lines[begin:end]])
            m, y = lines[line], row[line]
            x = first["x"][m] + _places(line)
            u, sigma = 0.5 * np.hypot(x - mark["x"][m], y - mark["y"][m]), mark["sigma"][m]
            one = _erf((u + math.sqrt(0.125)) / sigma) - _erf((u - math.sqrt(0.125)) / sigma)
            weight = one * one * 0.25 * sigma
            ty, tx = y // tile, x // tile
            names, which = np.unique(ty * (width // tile + 1) + tx, return_inverse=True)
            keys = list(zip((names // (width // tile + 1)).tolist(), (names % (width // tile + 1)).tolist(), strict=True))
            if slots and len(slots.keys() | set(keys)) > held:
                yield done()
                slots, canvas = {}, np.zeros((3, 0))
            slot = np.array([slots.setdefault(k, len(slots)) for k in keys], "i8")[which]
            if canvas.shape[1] < len(slots) * tile * tile:
                canvas = np.concatenate([canvas, np.zeros((3, len(slots) * tile * tile - canvas.shape[1]))], axis=1)
            cell = (slot * tile + y - ty * tile) * tile + x - tx * tile
            for k in range(3):
                np.add.at(canvas[k], cell, mark[f"c{k}"][m] * weight)
            begin = end
    if slots:
        yield done()


def _places(runs: np.ndarray) -> np.ndarray:
    """Place of each element inside its run of equal ones."""
    begins = np.nonzero(np.diff(runs, prepend=-1))[0]
    return np.arange(len(runs)) - np.repeat(begins, np.diff(begins, append=len(runs)))


def canvas(brush: DataFrame, width: int, height: int, tile: int = 64, held: int = 256) -> DataFrame:
    """y, x, v0, v1, v2: what the marks of brushes() add to a canvas, where it isn't zero.

    Each task sums its own marks by tile, of which it keeps about `held`, so marks aren't dealt and a tile under very many of them isn't left to one task.
    """
    found = brush.select("x", "y", "sigma", "reach", "c0", "c1", "c2").mapInArrow(partial(_paint, tile=tile, width=width, height=height, held=held), "y long, x long, v0 double, v1 double, v2 double")
    return found.groupBy("y", "x").agg(*(F.sum(c).alias(c) for c in ("v0", "v1", "v2")))

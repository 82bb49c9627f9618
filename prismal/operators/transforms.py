"""Two-dimensional cosine transforms of blocks of any size, and smoothing of a plane of block means.

A block is one row with its samples in an array; both passes of a transform are sums over that array with the basis as literals, so the
only shuffle is the one that brings a block together, and a block is as small as its size says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: weights of the four sides and of the four corners.
SIDE, CORNER = 0.20345139757231578, 0.0334829185968739


def basis(n: int) -> list[list[float]]:
    """Orthonormal rows u of the cosine transform of n samples."""
    return [[(math.sqrt(0.5) if u == 0 else 1.0) * math.sqrt(2 / n) * math.cos((2 * i + 1) * u * math.pi / (2 * n)) for i in range(n)] for u in range(n)]


def _product(values: Column, rows: int, columns: int, matrix: list[list[float]], along: str) -> Column:
    """values (rows x columns, in scan order) times the matrix along x or y, in scan order."""
    table = F.array(*(F.lit(c) for r in matrix for c in r))
    n = columns if along == "x" else rows

    def cell(k: Column) -> Column:
        y, x = F.floor(k / columns), k % columns
        at, line = (lambda i: (y * columns + i).cast("int"), x) if along == "x" else (lambda i: (i * columns + x).cast("int"), y)
        terms = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, at(i)) * F.get(table, (line * n + i).cast("int")))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), cell)


def _both(values: Column, h: int, w: int, ys: list[list[float]], xs: list[list[float]]) -> Column:
    first = F.transform(F.array(values), lambda v: _product(v, h, w, xs, "x"))
    return F.element_at(F.transform(first, lambda v: _product(v, h, w, ys, "y")), 1)


def blocks(plane: DataFrame, h: int, w: int) -> DataFrame:
    """img, by, bx, s: the samples (double, in scan order) of blocks of h x w that are whole; what is left at the right and below is in none."""
    place = lambda c, n: F.floor(F.col(c) / n).cast("long")
    dealt = plane.groupBy("img", place("y", h).alias("by"), place("x", w).alias("bx")).agg(F.array_sort(F.collect_list(F.struct((F.col("y") % h).alias("y"), (F.col("x") % w).alias("x"), F.col("v").cast("double").alias("v")))).alias("c"))
    return dealt.filter(F.size("c") == h * w).select("img", "by", "bx", F.transform("c", lambda x: x["v"]).alias("s"))


def forward(found: DataFrame, h: int, w: int) -> DataFrame:
    """blocks() with their coefficients in s, of vertical frequency times w plus horizontal frequency."""
    return found.withColumn("s", _both(F.col("s"), h, w, basis(h), basis(w)))


def inverse(found: DataFrame, h: int, w: int) -> DataFrame:
    turned = lambda n: [list(c) for c in zip(*basis(n), strict=True)]
    return found.withColumn("s", _both(F.col("s"), h, w, turned(h), turned(w)))


def smoothed(samples: DataFrame, steps: tuple[float, float, float]) -> DataFrame:
    """img, y, x, v0, v1, v2 moved towards the mean of their surroundings, the less the farther it lies in any channel (in its steps).

    Samples on the border of a plane stay.
    """
    down, across = Window.partitionBy("img", "x").orderBy("y"), Window.partitionBy("img", "y").orderBy("x")
    names = ("v0", "v1", "v2")
    tall = samples.select("img", "y", "x", *names, *(F.lag(c).over(down).alias(f"{c}_u") for c in names), *(F.lead(c).over(down).alias(f"{c}_d") for c in names))
    sides = {c: (F.lag(c).over(across) + F.lead(c).over(across) + F.col(f"{c}_u") + F.col(f"{c}_d")).alias(f"{c}_s") for c in names}
    corners = {c: (F.lag(f"{c}_u").over(across) + F.lead(f"{c}_u").over(across) + F.lag(f"{c}_d").over(across) + F.lead(f"{c}_d").over(across)).alias(f"{c}_c") for c in names}
    wide = tall.select("img", "y", "x", *names, *sides.values(), *corners.values())
    mean = {c: F.col(f"{c}_c") * CORNER + F.col(f"{c}_s") * SIDE + F.col(c) * (1 - 4 * (SIDE + CORNER)) for c in names}
    gap = F.greatest(F.lit(0.5), *(F.abs((F.col(c) - mean[c]) / s) for c, s in zip(names, steps, strict=True)))
    share = F.greatest(F.lit(0.0), 3 - 4 * gap)
    return wide.select("img", "y", "x", *(F.coalesce(F.col(c) + (mean[c] - F.col(c)) * share, F.col(c)).alias(c) for c in names))

"""Operators on sample planes in long form: (img, y, x, v), one row per sample.

Rows and columns are windows partitioned by (img, y) and (img, x), so a plane is dealt by its lines and no task holds an
image. All arithmetic is in BIGINT.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.scalar import div


def lines(df: DataFrame, img: str, order: str, values: str) -> DataFrame:
    """img, y, s: each row's array is a line of a plane per img, lines in the order given."""
    line = F.row_number().over(Window.partitionBy(img).orderBy(order)) - 1
    return df.select(F.col(img).cast("long").alias("img"), line.cast("long").alias("y"), F.col(values).alias("s"))


def from_arrays(df: DataFrame, img: str, order: str, values: str, scale: int = 1000) -> DataFrame:
    """A plane per img from lines(); samples scaled and rounded."""
    return lines(df, img, order, values).select("img", "y", F.posexplode("s").alias("x", "e")).select("img", "y", F.col("x").cast("long").alias("x"), F.round(F.col("e").cast("double") * scale).cast("long").alias("v"))


def neighbours(plane: DataFrame) -> DataFrame:
    """The plane with l, t, tl, tr, ll, tt, trr: what the predictors read, with their defaults at borders."""
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    up = plane.withColumn("_t", F.lag("v", 1).over(col)).withColumn("_tt", F.lag("v", 2).over(col))
    side = up.select("*", F.lag("v", 1).over(row).alias("_l"), F.lag("v", 2).over(row).alias("_ll"), F.lag("_t", 1).over(row).alias("_tl"), F.lead("_t", 1).over(row).alias("_tr"), F.lead("_t", 2).over(row).alias("_trr"))
    left = F.coalesce("_l", "_t", F.lit(0))
    top = F.coalesce("_t", left)
    top_right = F.coalesce("_tr", top)
    return side.select("img", "y", "x", "v", left.alias("l"), top.alias("t"), F.coalesce("_tl", left).alias("tl"), top_right.alias("tr"), F.coalesce("_ll", left).alias("ll"), F.coalesce("_tt", top).alias("tt"), F.coalesce("_trr", top_right).alias("trr"))


def predictor(name: str) -> Column:
    """Prediction from the columns of neighbours()."""
    l, t, tl, tr, ll, tt, trr = (F.col(c) for c in ("l", "t", "tl", "tr", "ll", "tt", "trr"))  # noqa: E741
    plane = l + t - tl
    kinds = {
        "zero": F.lit(0).cast("long"),
        "left": l,
        "top": t,
        "average0": div(l + t, 2),
        "average1": div(l + tl, 2),
        "average2": div(tl + t, 2),
        "average3": div(t + tr, 2),
        "average4": div(6 * t - 2 * tt + 7 * l + ll + trr + 3 * tr + 8, 16),
        "select": F.when(F.abs(plane - l) < F.abs(plane - t), l).otherwise(t),
        "gradient": F.when(tl < F.least(l, t), F.greatest(l, t)).when(tl > F.greatest(l, t), F.least(l, t)).otherwise(plane),
        "top_left": tl,
        "top_right": tr,
        "left_left": ll,
    }
    return kinds[name]


def predict(plane: DataFrame, names: list[str]) -> DataFrame:
    return neighbours(plane).select("img", "y", "x", "v", *(predictor(n).alias(n) for n in names))


def _tendency(b: Column, a: Column, n: Column) -> Column:
    """Expected difference of a pair from the value before, its average, and the average after: 0 unless monotone."""
    down = div(4 * b - 3 * n - a + 6, 12)
    down = F.when(down - (down % 2) > 2 * (b - a), 2 * (b - a) + 1).otherwise(down)
    down = F.when(down + (down % 2) > 2 * (a - n), 2 * (a - n)).otherwise(down)
    up = div(4 * b - 3 * n - a - 6, 12)
    up = F.when(up + F.abs(up % 2) < 2 * (b - a), 2 * (b - a) - 1).otherwise(up)
    up = F.when(up - F.abs(up % 2) < 2 * (a - n), 2 * (a - n)).otherwise(up)
    return F.when((b >= a) & (a >= n), down).when((b <= a) & (a <= n), up).otherwise(F.lit(0).cast("long"))


def squeeze(plane: DataFrame) -> DataFrame:
    """Horizontal squeeze: per pair of samples its average and the residual of its difference (even widths)."""
    pair = plane.groupBy("img", "y", div(F.col("x"), 2).alias("k")).agg(F.max(F.when(F.col("x") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("x") % 2 == 1, F.col("v"))).alias("b"))
    w = Window.partitionBy("img", "y").orderBy("k")
    a, b = F.col("a"), F.col("b")
    avg = pair.withColumn("avg", F.shiftright(a + b + F.when(a > b, 1).otherwise(0), 1))
    near = avg.withColumn("left", F.coalesce(F.lag("b").over(w), F.col("avg"))).withColumn("next", F.coalesce(F.lead("avg").over(w), F.col("avg")))
    return near.select("img", "y", "k", "avg", (a - b - _tendency(F.col("left"), F.col("avg"), F.col("next"))).alias("residual"))


def unsqueeze(squeezed: DataFrame) -> DataFrame:
    """Inverse of squeeze(): a fold along each line, which carries the last sample (its width bounds the state)."""
    line = squeezed.groupBy("img", "y").agg(F.array_sort(F.collect_list(F.struct("k", "avg", "residual"))).alias("p"))
    empty = F.array().cast("array<bigint>")

    def step(done: Column, i: Column) -> Column:
        p = F.col("p")
        avg = p[i]["avg"]
        left = F.when(i == 0, avg).otherwise(F.element_at(done, -1))
        following = F.when(i + 1 < F.size(p), F.get(p, i + 1)["avg"]).otherwise(avg)
        diff = p[i]["residual"] + _tendency(left, avg, following)
        first = avg + div(diff, 2)
        return F.concat(done, F.array(first, first - diff))

    folded = line.select("img", "y", F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), empty, step).alias("s"))
    return folded.select("img", "y", F.posexplode("s").alias("x", "v")).select("img", "y", F.col("x").cast("long").alias("x"), "v")


def orient(plane: DataFrame, kind: int, width: int, height: Column) -> DataFrame:
    """EXIF orientation 1 to 8 as a remap of coordinates."""
    x, y, w, h = F.col("x"), F.col("y"), F.lit(width).cast("long"), height
    to = {1: (y, x), 2: (y, w - 1 - x), 3: (h - 1 - y, w - 1 - x), 4: (h - 1 - y, x), 5: (x, y), 6: (x, h - 1 - y), 7: (w - 1 - x, h - 1 - y), 8: (w - 1 - x, y)}[kind]
    return plane.select("img", to[0].alias("y"), to[1].alias("x"), "v")


def tile_stats(plane: DataFrame, size: int = 8) -> DataFrame:
    return plane.groupBy("img", div(F.col("y"), size).alias("ty"), div(F.col("x"), size).alias("tx")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


def tile_norm(plane: DataFrame, size: int = 8, p: int = 4) -> DataFrame:
    return plane.groupBy("img", div(F.col("y"), size).alias("ty"), div(F.col("x"), size).alias("tx")).agg(F.round(F.pow(F.avg(F.pow(F.abs(F.col("v")) / 1000.0, F.lit(p))), F.lit(1.0 / p)), 6).alias("norm"))


def symmetric3(plane: DataFrame, w0: int, w1: int, w2: int) -> DataFrame:
    """3x3 symmetric integer kernel (centre, edge, corner), mirrored at borders; v becomes the weighted sum."""
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    side = plane.withColumn("s", F.coalesce(F.lag("v").over(row), F.col("v")) + F.coalesce(F.lead("v").over(row), F.col("v")))
    up = lambda c: F.coalesce(F.lag(c).over(col), F.col(c)) + F.coalesce(F.lead(c).over(col), F.col(c))
    return side.select("img", "y", "x", (w0 * F.col("v") + w1 * (F.col("s") + up("v")) + w2 * up("s")).alias("v"))


def upsample_chroma(plane: DataFrame) -> DataFrame:
    """Doubles the width: each sample gives (3 v + left) / 4 and (3 v + right) / 4."""
    row = Window.partitionBy("img", "y").orderBy("x")
    left, right = F.coalesce(F.lag("v").over(row), F.col("v")), F.coalesce(F.lead("v").over(row), F.col("v"))
    two = plane.select("img", "y", "x", F.array(div(3 * F.col("v") + left, 4), div(3 * F.col("v") + right, 4)).alias("p"))
    return two.select("img", "y", "x", F.posexplode("p").alias("k", "v")).select("img", "y", (2 * F.col("x") + F.col("k")).cast("long").alias("x"), "v")


def dct_basis(n: int) -> list[tuple[int, int, float]]:
    return [(u, x, (math.sqrt(0.5) if u == 0 else 1.0) * math.sqrt(2.0 / n) * math.cos((2 * x + 1) * u * math.pi / (2 * n))) for u in range(n) for x in range(n)]


def dct_rows(plane: DataFrame, n: int = 8) -> DataFrame:
    """Forward DCT of every run of n samples in a line: a join with the basis (n * n rows) and a sum."""
    basis = plane.sparkSession.createDataFrame(dct_basis(n), "u int, i int, c double")
    cells = plane.withColumn("i", (F.col("x") % n).cast("int")).withColumn("b", div(F.col("x"), n))
    return cells.join(F.broadcast(basis), "i").groupBy("img", "y", "b", "u").agg(F.sum(F.col("v") * F.col("c")).alias("coefficient"))


def inverse_dct_rows(coefficients: DataFrame, n: int = 8) -> DataFrame:
    basis = coefficients.sparkSession.createDataFrame(dct_basis(n), "u int, i int, c double")
    return coefficients.join(F.broadcast(basis), "u").groupBy("img", "y", (F.col("b") * n + F.col("i")).alias("x")).agg(F.round(F.sum(F.col("coefficient") * F.col("c"))).cast("long").alias("v"))


def zigzag(n: int = 8) -> list[tuple[int, int, int]]:
    """(position, y, x) of a block's coefficients along its anti-diagonals."""
    order = sorted(((y, x) for y in range(n) for x in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [(k, y, x) for k, (y, x) in enumerate(order)]

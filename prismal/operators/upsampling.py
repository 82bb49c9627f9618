"""Planes made 2, 4 or 8 times as wide and high by kernels of 5 x 5 samples.

Each sample gives factor x factor others. Each of those is a weighted sum of the 25 samples around it, by the kernel of its place, held between the
least and the greatest of the 25. All kernels follow by reflection from one symmetric matrix, of which the upper triangle is given, row by row.

The 25 samples come by two windows, along lines and then along columns, so a plane is dealt by its lines and no task holds an image. The kernels
are a literal, so nothing is joined. At borders samples are mirrored. A plane is whole: a row for each of its places, with a value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Fixed values of the format: upper triangles for factors 2 and 4. For 8 the caller gives 210 values.
WEIGHTS2 = (
    -0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645,
    0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550,
    0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539,
)
WEIGHTS4 = (
    -0.02419067, -0.03491987, -0.03693351, -0.03094285, -0.00529785,
    -0.01663432, -0.03556863, -0.03888905, -0.03516850, -0.00989469,
    0.23651958, 0.33392945, -0.01073543, -0.01313181, -0.03556694,
    0.13048175, 0.40103025, 0.03951150, -0.02077584, 0.46914198,
    -0.00209270, -0.01484589, -0.04064806, 0.18942530, 0.56279892,
    0.06674400, -0.02335494, -0.03551682, -0.00754830, -0.02267919,
    -0.02363578, 0.00315804, -0.03399098, -0.01359519, -0.00091653,
    -0.00335467, -0.01163294, -0.01610294, -0.00974088, -0.00191622,
    -0.01095446, -0.03198464, -0.04455121, -0.02799790, -0.00645912,
    0.06390599, 0.22963888, 0.00630981, -0.01897349, 0.67537268,
    0.08483369, -0.02534994, -0.02205197, -0.01667999, -0.00384443,
)
DEFAULT = {2: WEIGHTS2, 4: WEIGHTS4}


def kernels(factor: int, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """factor x factor x 5 x 5: the kernel of each place that a sample gives."""
    if factor not in (2, 4, 8):
        raise ValueError("a factor of 2, 4 or 8")
    half = factor // 2
    n = 5 * half
    given = np.array(weights if weights is not None else DEFAULT.get(factor, ()), "f8")
    if len(given) != n * (n + 1) // 2:
        raise ValueError(f"factor {factor} takes {n * (n + 1) // 2} weights, not {len(given)}")
    matrix = np.zeros((n, n))
    matrix[np.triu_indices(n)] = given
    matrix += np.triu(matrix, 1).T
    quarter = matrix.reshape(half, 5, half, 5).transpose(0, 2, 1, 3)
    upper = np.concatenate([quarter, quarter[:, ::-1, :, ::-1]], 1)  # right half: kernels turned about their middle column
    return np.concatenate([upper, upper[::-1, :, ::-1, :]], 0)


def _five(c: str, w: WindowSpec) -> list[Column]:
    """The value two and one before, itself, one and two behind; mirrored where the line ends, also in lines of one or two samples."""
    before, behind = F.lag(c).over(w), F.lead(c).over(w)
    return [F.coalesce(F.lag(c, 2).over(w), before, behind, F.col(c)), F.coalesce(before, F.col(c)), F.col(c), F.coalesce(behind, F.col(c)), F.coalesce(F.lead(c, 2).over(w), behind, before, F.col(c))]


def upsample(plane: DataFrame, factor: int, weights: tuple[float, ...] | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """img, y, x, v (double) of a plane (img, y, x, v) made larger; rows and columns from height and width on are cut off."""
    line, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    flat = plane.select("img", "y", "x", F.col("v").cast("double").alias("v"))
    lines = flat.select("img", "y", "x", F.array(*_five("v", line)).alias("s"))
    near = lines.select("img", "y", "x", F.concat(*_five("s", column)).alias("s"))
    bound = near.select("img", "y", "x", "s", F.array_min("s").alias("low"), F.array_max("s").alias("high"))
    k = kernels(factor, weights)
    places = [F.struct(F.lit(py).alias("py"), F.lit(px).alias("px"), *(F.lit(float(c)).alias(f"w{j}") for j, c in enumerate(k[py, px].ravel()))) for py in range(factor) for px in range(factor)]
    each = bound.select("*", F.inline(F.array(*places)))
    value = sum((F.col("s")[j] * F.col(f"w{j}") for j in range(1, 25)), F.col("s")[0] * F.col("w0"))
    y, x = ((F.col(c) * factor + F.col(f"p{c}")).cast("long").alias(c) for c in ("y", "x"))
    out = each.select("img", y, x, F.least(F.greatest(value, "low"), "high").alias("v"))
    for c, end in (("y", height), ("x", width)):
        out = out if end is None else out.filter(F.col(c) < end)
    return out

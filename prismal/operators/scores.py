"""Multi-scale score of how alike two pictures look, from 100 (the same) down.

At each of up to six scales, halved in linear light, both pictures become three positive opponent channels; blurred means, squares and products
give a structural error a sample, and the differences from the means give errors of edges that were added and of detail that was lost. Each
map is pooled by its mean and by its fourth norm, and the norms are weighed. All pictures of a table go through a scale at once, dealt
once by tiles, which also hold the strips around them that the blur's kernel reaches; only sums leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.colour import ABSORBANCE, BIAS
from prismal.operators import blur
from prismal.tables import forget, written

# Fixed values of the published score: the scales, the constant of the structural error, the weights (channel, scale, norm, map) and the curve.
SCALES, C2, SIGMA = 6, 0.0009, 1.5
WEIGHTS = (
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0,
    0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0,
    0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053,
    0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262,
    0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985,
    176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0,
    0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379,
    0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
)
CURVE = (0.9562382616834844, 2.326765642916932, -0.020884521182843837, 6.248496625763138e-05, 10.0, 0.6276336467831387)
COLORS = ("r1", "g1", "b1", "r2", "g2", "b2")
SUMS = tuple(f"{m}_{p}" for m in ("structure", "added", "lost") for p in (1, 4))
#: Samples along a side of a tile.
TILE = 128


def positive(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X, Y and B - Y of linear RGB, shifted and stretched to 0 .. 1."""
    low = BIAS ** (1 / 3.0)
    long, middle, short = (np.cbrt(np.maximum(m[0] * r + m[1] * g + m[2] * b + BIAS, 0)) - low for m in ABSORBANCE)
    y = (long + middle) * 0.5
    return (long - middle) * 0.5 * 14.0 + 0.42, y + 0.01, short - y + 0.55


def _blurred(v: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A tile, with the strips around it that the kernel needs, blurred along both axes; the strips go."""
    for axis in (-1, -2):
        n = v.shape[axis] - len(taps) + 1
        v = sum(w * v.take(range(k, k + n), axis) for k, w in enumerate(taps))
    return v


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Rows sorted by img and tile: the columns of one tile after the other."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[dict, dict[str, np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return {c: rows[c][0].as_py() for c in ("img", "ty", "tx", "w", "h")}, {c: rows[c].to_numpy() for c in ("y", "x", *COLORS)}

    for b in batches:
        keys = np.array([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("img", "ty", "tx")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for begin, end in pairwise(cuts):
            part = b.slice(begin, end - begin)
            if held and part.num_rows and any(held[0][c][0] != part[c][0] for c in ("img", "ty", "tx")):
                yield whole()
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield whole()


def _maps(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Sums over the samples of a tile: img, w, h, c, n and six sums of its maps."""
    taps = np.array(blur.kernel(SIGMA))
    edge = len(taps) // 2
    for at, rows in _tiles(batches):
        top, left = at["ty"] * tile, at["tx"] * tile
        high, wide = min(tile, at["h"] - top), min(tile, at["w"] - left)
        y, x = rows["y"] - top + edge, rows["x"] - left + edge
        light = {}
        there = np.zeros((high + 2 * edge, wide + 2 * edge))
        there[y, x] = 1
        for c in COLORS:
            light[c] = np.zeros(there.shape)
            light[c][y, x] = rows[c]
        # beyond the ends of the picture there are zeros
        first, second = ([v * there for v in positive(*(light[f"{c}{k}"] for c in "rgb"))] for k in (1, 2))
        inner = (slice(edge, edge + high), slice(edge, edge + wide))
        on = there[inner] > 0
        out = []
        for c, (a, b) in enumerate(zip(first, second, strict=True)):
            m1, m2, aa, bb, ab = _blurred(np.array([a, b, a * a, b * b, a * b]), taps)
            shape = (2 * (ab - m1 * m2) + C2) / (aa - m1 * m1 + bb - m2 * m2 + C2)
            change = (1 + np.abs(b[inner] - m2)) / (1 + np.abs(a[inner] - m1)) - 1
            maps = (np.maximum(1 - (1 - (m1 - m2) ** 2) * shape, 0), np.maximum(change, 0), np.maximum(-change, 0))
            out.append([at["img"], at["w"], at["h"], c, int(on.sum()), *(float((m[on] if p == 1 else np.square(np.square(m[on]))).sum()) for m in maps for p in (1, 4))])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["img", "w", "h", "c", "n", *SUMS])


def halved(pictures: DataFrame) -> DataFrame:
    """Means of 2 x 2 samples; the last row and column are repeated where their number is odd."""
    twice = lambda c, n: F.when((F.col(c) == F.col(n) - 1) & (F.col(c) % 2 == 0), 2).otherwise(1)
    share = twice("x", "w") * twice("y", "h") / 4.0
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    size = lambda c: F.floor((F.max(c) + 1) / 2).cast("long").alias(c)
    return pictures.groupBy("img", half("y"), half("x")).agg(size("w"), size("h"), *(F.sum(F.col(c) * share).alias(c) for c in COLORS))


def _errors(pictures: DataFrame, tile: int) -> DataFrame:
    """img, c and six pooled errors of one scale."""
    edge = len(blur.kernel(SIGMA)) // 2
    # a sample goes to its tile, and to those that have it in their strips
    last = lambda n: F.floor((F.col(n) - 1) / tile)
    tiles = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - edge) / tile)), F.least(last(n), F.floor((F.col(c) + edge) / tile))).cast("array<long>"))
    filed = pictures.withColumn("ty", tiles("y", "h")).withColumn("tx", tiles("x", "w"))
    dealt = filed.repartition("img", "ty", "tx").sortWithinPartitions("img", "ty", "tx").select("img", "ty", "tx", "w", "h", "y", "x", *COLORS)
    sums = dealt.mapInArrow(partial(_maps, tile=tile), f"img long, w long, h long, c long, n long, {', '.join(f'{n} double' for n in SUMS)}")
    mean = lambda n: F.sum(n) / F.sum("n")
    return sums.groupBy("img", "c").agg(*((F.pow(mean(n), 0.25) if n.endswith("4") else mean(n)).alias(n) for n in SUMS))


def score(pictures: DataFrame, tile: int = TILE) -> DataFrame:
    """img, scales, error (the weighed sum) and score of pairs of pictures: img, y, x, r1, g1, b1, r2, g2, b2 in linear light, 0 to 1."""
    sizes = pictures.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    large = "w >= 8 and h >= 8"
    now, found = written(pictures.join(sizes, "img").filter(large), "pictures"), None
    for scale in range(SCALES):
        if scale:
            smaller = written(halved(now.filter(large)), "pictures")
            forget(now)
            now = smaller
        if now.isEmpty():
            break
        errors = written(_errors(now, tile), "scale-errors").withColumn("scale", F.lit(scale))
        found = errors if found is None else found.union(errors)
    if found is None:
        return pictures.sparkSession.createDataFrame([], "img long, scales long, error double, score double")
    scales = F.max("scale").over(Window.partitionBy("img")) + 1
    maps = F.array(*(F.struct(F.lit(n * 3 + k).alias("k"), F.col(f"{m}_{p}").alias("e")) for n, p in enumerate((1, 4)) for k, m in enumerate(("structure", "added", "lost"))))
    terms = found.withColumn("scales", scales.cast("long")).select("img", "scales", "c", "scale", F.explode(maps).alias("m"))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("c") * F.col("scales") + F.col("scale")) * 6 + F.col("m.k") + 1).cast("int"))
    total = terms.groupBy("img", "scales").agg(F.sum(F.abs("m.e") * weight).alias("error"))
    first, p, q, r, times, power = CURVE
    e = F.col("error") * first
    curve = p * e + q * e * e + r * e * e * e
    return total.select("img", "scales", "error", F.when(curve > 0, 100.0 - times * F.pow(curve, power)).otherwise(100.0).alias("score"))

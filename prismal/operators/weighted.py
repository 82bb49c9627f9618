"""The self-correcting predictor: four sub-predictions weighted by their past errors, a state that is carried along both axes.

A plane is dealt in groups of `group` x `group` samples, each with a state of its own that starts at zero, as groups are
coded independently; so a task holds a group, whatever the size of the plane. In a group, a sample needs the errors left of it and those of three
above, so all samples with the same x + 2 y are computed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: weights of the sub-predictions, and the factors of the errors in them.
WEIGHTS = (13, 12, 12, 12)
P1, P2, P3A, P3B, P3C, P3D, P3E = 16, 10, 7, 7, 7, 0, 0
#: Samples are held with so many more bits.
BITS = 3
RECIPROCAL = (1 << 24) // np.arange(1, 65)


def _log2(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype("f8"))[1] - 1


def predictions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a group (y, x): the predictions, and of the errors around each sample the largest in size."""
    h, w = v.shape
    # one more row above and one more column on either side stand for what lies outside
    error = np.zeros((h + 1, w + 2), "i8")
    sizes = np.zeros((4, h + 1, w + 2), "i8")
    out, most = np.zeros((h, w), "i8"), np.zeros((h, w), "i8")
    half = (1 << BITS >> 1) - 1
    for wave in range(w + 2 * h - 2):
        y = np.arange(max(0, (wave - w + 2) // 2), min(h - 1, wave // 2) + 1)
        x = wave - 2 * y
        first, last, top = x == 0, x == w - 1, y == 0
        at = lambda dy, dx: v[np.maximum(y + dy, 0), np.clip(x + dx, 0, w - 1)]  # noqa: E731, B023
        left = np.where(first, np.where(top, 0, at(-1, 0)), at(0, -1))
        up = np.where(top, left, at(-1, 0))
        up_left = np.where(first | top, left, at(-1, -1))
        up_right = np.where(last | top, up, at(-1, 1))
        up_up = np.where(y < 2, up, at(-2, 0))
        n, west, ne, nw, nn = (a << BITS for a in (up, left, up_right, up_left, up_up))

        # column x of a plane is column x + 1 here; beyond a border stands the column above the sample
        right, before = np.where(last, x, x + 1) + 1, np.where(first, x, x - 1) + 1
        e_n, e_ne, e_nw = error[y, x + 1], error[y, right], error[y, before]
        e_w = np.where(first, 0, error[y + 1, x])
        sub = np.stack(
            [
                west + ne - n,
                n - ((e_w + e_n + e_ne) * P1 >> 5),
                west - ((e_w + e_n + e_nw) * P2 >> 5),
                n - (e_nw * P3A + e_n * P3B + e_ne * P3C + (nn - n) * P3D + (nw - west) * P3E >> 5),
            ]
        )
        # each error also counts at the place above its right neighbour
        s_n = sizes[:, y, x + 1] + np.where(first, 0, sizes[:, y + 1, x])
        s_nw = np.where(first, s_n, sizes[:, y, x] + np.where(x > 1, sizes[:, y + 1, np.maximum(x - 1, 0)], 0))
        s_ne = np.where(last, s_n, sizes[:, y, np.minimum(x + 2, w + 1)])
        total = s_n + s_ne + s_nw
        shift = np.maximum(_log2(total + 1) - 5, 0)
        weight = 4 + (np.array(WEIGHTS)[:, None] * RECIPROCAL[total >> shift] >> shift)
        weight = weight >> np.maximum(_log2(weight.sum(0)) - 4, 0)
        parts = weight.sum(0)
        mean = ((parts >> 1) - 1 + (sub * weight).sum(0)) * RECIPROCAL[parts - 1] >> 24
        apart = ((e_n ^ e_w) | (e_n ^ e_nw)) > 0
        mean = np.where(apart, mean, np.clip(mean, np.minimum(west, np.minimum(ne, n)), np.maximum(west, np.maximum(ne, n))))
        out[y, x] = mean + half >> BITS
        for e in (e_n, e_nw, e_ne):
            e_w = np.where(np.abs(e) > np.abs(e_w), e, e_w)
        most[y, x] = e_w
        true = v[y, x] << BITS
        error[y + 1, x + 1] = mean - true
        sizes[:, y + 1, x + 1] = np.abs(sub - true) + half >> BITS
    return out, most


def _groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for img, ty, tx, cells in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            y, x, v = (cells.values.field(k).to_numpy() for k in range(3))
            y0, x0 = ty * group, tx * group
            plane = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), "i8")
            plane[y - y0, x - x0] = v
            found, most = predictions(plane)
            k = len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, img)), pa.array(y), pa.array(x), pa.array(v), pa.array(found[y - y0, x - x0]), pa.array(most[y - y0, x - x0])], ["img", "y", "x", "v", "prediction", "error"])


def weighted(plane: DataFrame, group: int = 256) -> DataFrame:
    """img, y, x, v, prediction, error (the property of that name) of every sample; groups are whole rectangles of samples."""
    tile = lambda c: F.floor(F.col(c) / group).cast("long")
    dealt = plane.groupBy("img", tile("y").alias("ty"), tile("x").alias("tx")).agg(F.collect_list(F.struct("y", "x", "v")).alias("cells"))
    return dealt.mapInArrow(partial(_groups, group=group), "img long, y long, x long, v long, prediction long, error long")

"""Larger planes against plain loops."""

import itertools

import numpy as np
import pytest

from prismal.operators import upsampling


def plain(v, f, weights):
    """A loop over places, with the weight looked up in the list by its row and column of the triangle."""
    h, w = v.shape
    place = {}
    for i in range(5 * f // 2):
        for j in range(i, 5 * f // 2):
            place[i, j] = place[j, i] = len(set(place.values()))
    out = np.zeros((h * f, w * f))
    for y, x in itertools.product(range(h * f), range(w * f)):
        got, total = [], 0.0
        for dy, dx in itertools.product(range(-2, 3), repeat=2):
            sy, sx = (y // f + dy) % (2 * h), (x // f + dx) % (2 * w)
            s = v[min(sy, 2 * h - 1 - sy), min(sx, 2 * w - 1 - sx)]
            py, px = y % f, x % f
            i = 5 * min(px, f - 1 - px) + 2 + (dx if px < f // 2 else -dx)
            j = 5 * min(py, f - 1 - py) + 2 + (dy if py < f // 2 else -dy)
            got.append(s)
            total += s * weights[place[i, j]]
        out[y, x] = min(max(total, min(got)), max(got))
    return out


@pytest.mark.parametrize("factor", [2, 4, 8])
def test_planes_of_any_size(spark, factor):
    draw = np.random.default_rng(factor)
    n = 5 * factor // 2
    weights = upsampling.DEFAULT.get(factor) or tuple(draw.normal(0.04, 0.1, n * (n + 1) // 2).tolist())
    planes = [draw.integers(-500, 500, s) for s in ((1, 1), (2, 3), (3, 1), (1, 2), (7, 6))]
    rows = [(k, y, x, int(v[y, x])) for k, v in enumerate(planes) for y, x in np.ndindex(v.shape)]
    df = spark.createDataFrame(rows, "img long, y long, x long, v long").repartition(3)
    found = {(r.img, r.y, r.x): r.v for r in upsampling.upsample(df, factor, None if factor < 8 else weights).collect()}
    assert len(found) == len(rows) * factor * factor
    for k, v in enumerate(planes):
        want = plain(v, factor, weights)
        for y, x in np.ndindex(want.shape):
            assert found[k, y, x] == pytest.approx(want[y, x], abs=1e-8)


def test_flat_planes_stay_and_sizes_are_cut(spark):
    df = spark.createDataFrame([(0, y, x, 7) for y in range(3) for x in range(4)], "img long, y long, x long, v long")
    found = upsampling.upsample(df, 4, height=11, width=13).collect()
    assert {(r.y, r.x) for r in found} == set(itertools.product(range(11), range(13))) and {r.v for r in found} == {7.0}
    assert upsampling.upsample(df.limit(0), 2).count() == 0


def test_wrong_factors_and_weights_are_refused():
    for factor, weights in ((3, None), (8, None), (2, (1.0,))):
        with pytest.raises(ValueError):
            upsampling.kernels(factor, weights)

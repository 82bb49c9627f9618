"""Edge-preserving filter in up to three passes over planes of three channels.

Each pass weighs the samples around one by how alike their surroundings are. Planes are tiles; between passes a tile gives only the strips along
its border to the tiles around it, so what is moved a pass grows with the borders, not with the samples. At the borders of an image the
samples are mirrored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.tables import forget, written

# Fixed values of the format.
CHANNEL_SCALE, PASS_SCALE, BORDER, LEAST_SIGMA = (40.0, 5.0, 3.5), (0.9, 1.0, 6.5), 2 / 3, -3.90524291751269967465540850526868
PLUS = ((0, 0), (0, -1), (-1, 0), (0, 1), (1, 0))
ADJACENT = ((-1, 0), (0, -1), (0, 1), (1, 0))
WIDE = tuple((y, x) for y in range(-2, 3) for x in range(-2, 3) if 0 < abs(y) + abs(x) <= 2)
#: Samples beyond a tile that a pass reads.
HALO = 3
TILE = "img long, ty long, tx long, h long, w long, sigma array<double>, v array<double>"


def one_pass(v: np.ndarray, sigma: np.ndarray, stage: int, y0: int, x0: int) -> np.ndarray:
    """v: channels x (h + 6) x (w + 6), a tile that begins at y0, x0 with its halo; sigma: of each sample. Returns channels x h x w."""
    h, w = sigma.shape
    offsets, patch = WIDE if stage == 0 else ADJACENT, PLUS[:1] if stage == 2 else PLUS
    at = lambda dy, dx: v[:, HALO + dy : HALO + dy + h, HALO + dx : HALO + dx + w]
    y, x = np.arange(y0, y0 + h)[:, None] % 8, np.arange(x0, x0 + w)[None, :] % 8
    edge = (y == 0) | (y == 7) | (x == 0) | (x == 7)
    factor = sigma * (1.65 * PASS_SCALE[stage]) * np.where(edge, BORDER, 1.0)
    total, sums = np.ones((h, w)), at(0, 0).astype("f8").copy()
    for dy, dx in offsets:
        apart = np.zeros((h, w))
        for c in range(3):
            apart += CHANNEL_SCALE[c] * sum(np.abs(at(py, px)[c] - at(py + dy, px + dx)[c]) for py, px in patch)
        weight = np.maximum(1 + apart * factor, 0)
        total += weight
        sums += weight * at(dy, dx)
    return np.where(sigma < LEAST_SIGMA, at(0, 0), sums / total)


def _mirrored(a: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """a with `low` samples before and `high` behind along an axis, mirrored about its ends, as often as it takes."""
    n = a.shape[axis]
    k = np.arange(-low, n + high) % (2 * n)
    return np.take(a, np.where(k < n, k, 2 * n - 1 - k), axis)


def _pass(batches: Iterator[pa.RecordBatch], stage: int, tile: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for img, ty, tx, h, w, sigma, v, strips in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            wide = np.full((3, h + 2 * HALO, w + 2 * HALO), np.nan)
            own = np.array(v).reshape(3, h, w)
            wide[:, HALO : HALO + h, HALO : HALO + w] = own
            for s in strips or []:
                part = np.array(s["v"]).reshape(3, s["h"], s["w"])
                y = HALO - s["h"] if s["dy"] < 0 else HALO + h if s["dy"] > 0 else HALO
                x = HALO - s["w"] if s["dx"] < 0 else HALO + w if s["dx"] > 0 else HALO
                wide[:, y : y + s["h"], x : x + s["w"]] = part
            # where there is no tile, or a narrow last one, the image ends: its samples are mirrored there
            rows = np.flatnonzero(~np.isnan(wide[0, :, HALO]))
            columns = np.flatnonzero(~np.isnan(wide[0, HALO, :]))
            inner = wide[:, rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
            full = _mirrored(_mirrored(inner, rows[0], wide.shape[1] - 1 - rows[-1], 1), columns[0], wide.shape[2] - 1 - columns[-1], 2)
            found = one_pass(full, np.array(sigma).reshape(h, w), stage, ty * tile, tx * tile)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (img, ty, tx, h, w, sigma)] + [pa.array([found.ravel().tolist()])], [x.split()[0] for x in TILE.split(", ")])


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for img, ty, tx, cells in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            y, x, *rest = (cells.values.field(k).to_numpy() for k in ("y", "x", "sigma", "v0", "v1", "v2"))
            y, x = y - ty * tile, x - tx * tile
            h, w = int(y.max()) + 1, int(x.max()) + 1
            planes = np.zeros((4, h, w))
            planes[:, y, x] = rest
            yield pa.RecordBatch.from_arrays([pa.array([k]) for k in (img, ty, tx, h, w)] + [pa.array([planes[0].ravel().tolist()]), pa.array([planes[1:].ravel().tolist()])], [x.split()[0] for x in TILE.split(", ")])


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a tile gives to each of the eight around it; dy, dx say where the giver lies from there."""
    names = ["img", "ty", "tx", "dy", "dx", "h", "w", "v"]
    for b in batches:
        for img, ty, tx, h, w, v in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)), strict=True):
            own = np.array(v).reshape(3, h, w)
            cut = lambda d, n: slice(0, min(HALO, n)) if d > 0 else slice(max(0, n - HALO), n) if d < 0 else slice(0, n)
            rows = []
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if dy or dx:
                        part = own[:, cut(dy, h), cut(dx, w)]
                        rows.append((img, ty - dy, tx - dx, dy, dx, part.shape[1], part.shape[2], part.ravel().tolist()))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _samples(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for img, ty, tx, h, w, v in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)), strict=True):
            y, x = np.mgrid[ty * tile : ty * tile + h, tx * tile : tx * tile + w]
            c = np.array(v).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, img)), pa.array(y.ravel()), pa.array(x.ravel()), *(pa.array(k) for k in c)], ["img", "y", "x", "v0", "v1", "v2"])


def edge_preserving(samples: DataFrame, passes: tuple[int, ...] = (0, 1, 2), tile: int = 256) -> DataFrame:
    """img, y, x, v0, v1, v2 (double) filtered. samples also has sigma, the same for a block of 8 x 8 (below LEAST_SIGMA: left as it is)."""
    if tile % 8 or tile < HALO:
        raise ValueError("a tile holds whole blocks of 8")
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    values = [F.col(c).cast("double").alias(c) for c in ("sigma", "v0", "v1", "v2")]
    dealt = samples.groupBy(F.col("img").cast("long").alias("img"), place("y").alias("ty"), place("x").alias("tx")).agg(F.collect_list(F.struct("y", "x", *values)).alias("cells"))
    tiles = written(dealt.mapInArrow(partial(_tiles, tile=tile), TILE), "tiles")
    for stage in passes:
        strips = tiles.mapInArrow(_strips, "img long, ty long, tx long, dy long, dx long, h long, w long, v array<double>")
        near = strips.groupBy("img", "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "h", "w", "v")).alias("strips"))
        with_strips = tiles.join(near, ["img", "ty", "tx"], "left").select(*(x.split()[0] for x in TILE.split(", ")), "strips")
        now = written(with_strips.mapInArrow(partial(_pass, stage=stage, tile=tile), TILE), "tiles")
        forget(tiles)
        tiles = now
    return tiles.mapInArrow(partial(_samples, tile=tile), "img long, y long, x long, v0 double, v1 double, v2 double")

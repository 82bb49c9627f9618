"""Recursive Gaussian blur of lines of any length: three linear recurrences run as a scan over blocks.

A line is cut into blocks; a block also holds the few samples beyond its ends that its sums need, which alone are moved twice. Each block runs
its recurrences from a state of zero. As a recurrence is linear, the true state at a block's end is its own end state plus a power of the
step matrix times the state before, so the states of all blocks follow from a fold over six numbers a block, read in order and held one at a time, and each block adds the answer to
the state that reaches it. Beyond the ends of a line there are zeros, as in the definition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.tables import written

BLOCK = 4096


@lru_cache(64)
def coefficients(sigma: float) -> tuple[int, tuple[float, ...], tuple[float, ...]]:
    """Radius, factors of the input, and factors of the last output, of the three recurrences out = n in - d last - (last but one).

    Truncated cosines after Charalampidis (2016): the kernel sums to one and has the variance of the Gaussian.
    """
    radius = round(3.2795 * sigma + 0.2546)
    step = math.pi / (2 * radius)
    omega = [step, 3 * step, 5 * step]
    p = [1 / math.tan(0.5 * omega[0]), -1 / math.tan(0.5 * omega[1]), 1 / math.tan(0.5 * omega[2])]
    r = [p[0] ** 2 / math.sin(omega[0]), -(p[1] ** 2) / math.sin(omega[1]), p[2] ** 2 / math.sin(omega[2])]
    rho = [math.exp(-0.5 * (sigma * w) ** 2) / radius for w in omega]
    d13, d35, d51 = (p[a] * r[b] - r[a] * p[b] for a, b in ((0, 1), (1, 2), (2, 0)))
    zeta = (d35 / d13, d51 / d13)
    beta = np.linalg.solve(np.array([p, r, [zeta[0], zeta[1], 1]]), np.array([1, radius * radius - sigma * sigma, zeta[0] * rho[0] + zeta[1] * rho[1] + rho[2]]))
    return radius, tuple(-b * math.cos(w * (radius + 1)) for b, w in zip(beta, omega, strict=True)), tuple(-2 * math.cos(w) for w in omega)


def kernel(sigma: float) -> list[float]:
    """The blur as weights of the samples at -radius + 1 .. radius - 1 around."""
    radius, n, d = coefficients(sigma)
    length = 4 * radius + 1
    line = np.zeros(length)
    line[2 * radius] = 1
    return sequential(line, sigma)[radius + 1 : 3 * radius].tolist()


def sequential(line: np.ndarray, sigma: float) -> np.ndarray:
    """The recurrences run sample after sample."""
    radius, n, d = coefficients(sigma)
    at = lambda k: line[k] if 0 <= k < len(line) else 0.0
    out, last, before = np.zeros(len(line)), [0.0] * 3, [0.0] * 3
    for k in range(1 - radius, len(line)):
        total = at(k - radius - 1) + at(k + radius - 1)
        now = [n[i] * total - d[i] * last[i] - before[i] for i in range(3)]
        last, before = now, last
        if k >= 0:
            out[k] = sum(now)
    return out


def _answers(d: tuple[float, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """What states (last, before) of 1, 0 and of 0, 1 give in the samples after them, for each recurrence."""
    first, second = np.zeros((3, length)), np.zeros((3, length))
    for out, state in ((first, (1.0, 0.0)), (second, (0.0, 1.0))):
        last, before = np.full(3, state[0]), np.full(3, state[1])
        for k in range(length):
            last, before = -np.array(d) * last - before, last
            out[:, k] = last
    return first, second


def _blocks(batches: Iterator[pa.RecordBatch], sigma: float, size: int) -> Iterator[pa.RecordBatch]:
    """Each block of a line from a state of zero: its outputs by recurrence and the states at its end."""
    radius, n, d = coefficients(sigma)
    n, d = np.array(n), np.array(d)
    for b in batches:
        for line, block, length, cells in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            x, v = cells.values.field("x").to_numpy(), cells.values.field("v").to_numpy()
            # the first block of a line also runs the steps before its first sample
            low, high = block * size - (radius - 1 if block == 0 else 0), min((block + 1) * size, length)
            window = np.zeros(high - low + 2 * radius)
            window[x - (low - radius - 1)] = v
            steps = high - low
            total = window[:steps] + window[2 * radius : 2 * radius + steps]
            out, last, before = np.zeros((3, steps)), np.zeros(3), np.zeros(3)
            for k in range(steps):
                last, before = n * total[k] - d * last - before, last
                out[:, k] = last
            yield pa.RecordBatch.from_arrays([pa.array([line]), pa.array([block]), pa.array([steps]), pa.array([last.tolist()]), pa.array([before.tolist()]), pa.array([out.sum(0)[steps - (high - block * size) :].tolist()])], ["line", "block", "steps", "last", "before", "out"])


def _settled(batches: Iterator[pa.RecordBatch], sigma: float, size: int) -> Iterator[pa.RecordBatch]:
    """Outputs with the answer to the state that reaches each block."""
    _, _, d = coefficients(sigma)
    answers = _answers(d, size)
    for b in batches:
        for line, block, last, before, out in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            v = np.array(out)
            if last is not None:
                v = v + (np.array(last)[:, None] * answers[0][:, : len(v)] + np.array(before)[:, None] * answers[1][:, : len(v)]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), line)), pa.array(block * size + np.arange(len(v))), pa.array(v)], ["line", "x", "v"])


def _fold(batches: Iterator[pa.RecordBatch], sigma: float, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and block: the state that reaches each block but the first of its line. Six numbers are held."""
    first, second = _answers(coefficients(sigma)[2], size)
    now, last, before = None, np.zeros(3), np.zeros(3)
    for b in batches:
        out = []
        for line, block, own_last, own_before in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if line != now:
                now, last, before = line, np.zeros(3), np.zeros(3)
            else:
                out.append((line, block, last.tolist(), before.tolist()))
            last, before = first[:, -1] * last + second[:, -1] * before + own_last, first[:, -2] * last + second[:, -2] * before + own_before
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["line", "block", "last", "before"])


def lines(df: DataFrame, sigma: float, size: int = BLOCK) -> DataFrame:
    """line, x, v (double) of lines of samples at x = 0, 1, ..., blurred along x."""
    radius = coefficients(sigma)[0]
    if size <= 2 * radius:
        raise ValueError("a block has to be longer than two radii")
    rows = df.select(F.col("line").cast("long").alias("line"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    length = rows.groupBy("line").agg((F.max("x") + 1).alias("length"))
    place = lambda x: F.floor(x / size).cast("long")
    near = F.array_distinct(F.array(place(F.greatest(F.col("x") - radius + 1, F.lit(0))), place(F.col("x")), place(F.col("x") + radius + 1)))
    dealt = rows.select("*", F.explode(near).alias("block")).groupBy("line", "block").agg(F.collect_list(F.struct("x", "v")).alias("cells"))
    placed = dealt.join(length, "line").filter(F.col("block") * size < F.col("length")).select("line", "block", "length", "cells")
    found = written(placed.mapInArrow(partial(_blocks, sigma=sigma, size=size), "line long, block long, steps long, last array<double>, before array<double>, out array<double>"), "blur-blocks")
    ends = found.select("line", "block", "last", "before").repartition("line").sortWithinPartitions("line", "block")
    states = ends.mapInArrow(partial(_fold, sigma=sigma, size=size), "line long, block long, last array<double>, before array<double>")
    joined = found.select("line", "block", "out").join(states, ["line", "block"], "left").select("line", "block", "last", "before", "out")
    return joined.mapInArrow(partial(_settled, sigma=sigma, size=size), "line long, x long, v double")


def plane(df: DataFrame, sigma: float, size: int = BLOCK) -> DataFrame:
    """img, y, x, v of planes, blurred along their rows and then along their columns."""
    span = 1 << 31
    across = lines(df.select((F.col("img") * span + F.col("y")).alias("line"), "x", "v"), sigma, size)
    split = across.select(F.shiftright("line", 31).alias("img"), F.col("line").bitwiseAND(F.lit(span - 1)).alias("y"), "x", "v")
    down = lines(split.select((F.col("img") * span + F.col("x")).alias("line"), F.col("y").alias("x"), "v"), sigma, size)
    return down.select(F.shiftright("line", 31).alias("img"), F.col("x").alias("y"), F.col("line").bitwiseAND(F.lit(span - 1)).alias("x"), "v")

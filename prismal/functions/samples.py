"""Column functions on samples: alpha, spot colour, scaling, dither, half floats, byte order, time codes, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismal.functions.scalar import clamp, div


def premultiply(c: Column, alpha: Column) -> Column:
    return c * alpha


def flatten(c: Column, alpha: Column, background: float) -> Column:
    return c * alpha + background * (1 - alpha)


def spot(c: Column, amount: Column, colour: float, solidity: float) -> Column:
    mix = amount * solidity
    return mix * colour + (1 - mix) * c


def hlg_gain(r: Column, g: Column, b: Column, gamma: float) -> Column:
    """Factor of the display transform: luminance to the power gamma - 1 (BT.2100 weights)."""
    return F.pow(0.2627 * r + 0.6780 * g + 0.0593 * b, F.lit(gamma - 1))


def to_integer(x: Column, bits: int) -> Column:
    return F.floor(clamp(x, 0.0, 1.0) * ((1 << bits) - 1) + 0.5).cast("long")


def bayer(n: int) -> list[list[int]]:
    """Ordered-dither ranks of an n x n cell (n a power of two), by the recursive rule."""
    if n == 1:
        return [[0]]
    half = bayer(n // 2)
    return [[4 * half[y % (n // 2)][x % (n // 2)] + (0, 2, 3, 1)[2 * (y >= n // 2) + (x >= n // 2)] for x in range(n)] for y in range(n)]


def dither(x: Column, row: Column, col: Column, bits: int, n: int = 8) -> Column:
    ranks = F.array(*(F.lit((v + 0.5) / (n * n)) for line in bayer(n) for v in line))
    at = ((row % n) * n + col % n).cast("int")
    return clamp(F.floor(x * ((1 << bits) - 1) + F.element_at(ranks, at + 1)), 0, (1 << bits) - 1).cast("long")


def half(bits: Column) -> Column:
    """Value of a binary16 number given as an integer; infinite and not-a-number as null."""
    sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
    e, m = div(bits, 1024) % 32, bits % 1024
    return F.when(e == 31, None).when(e == 0, sign * m * 2.0**-24).otherwise(sign * (1 + m / 1024.0) * F.pow(F.lit(2.0), e - 15))


def load_be(data: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def load_le(data: Column, start: int, size: int) -> Column:
    ordered = F.concat(*(F.hex(F.substring(data, start + k, 1)) for k in range(size - 1, -1, -1)))
    return F.conv(ordered, 16, 10).cast("long")


def timecode(frames: Column, rate: int) -> Column:
    """HH:MM:SS:FF of a frame number."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = div(frames, rate)
    return F.concat_ws(":", two(div(s, 3600)), two(div(s, 60) % 60), two(s % 60), two(frames % rate))


def bucket(v: Column, thresholds: list[int]) -> Column:
    """How many thresholds are below the value."""
    return reduce(lambda a, b: a + b, (F.when(v > t, 1).otherwise(0) for t in thresholds)).cast("long")


def codec_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin("jpg", "jpeg"), "jpeg").when(extension.isin("pgm", "ppm", "pfm", "pam", "pnm"), "pnm").when(extension.isin("png", "apng"), "png").when(extension.isin("gif", "exr", "pgx", "jxl", "npy"), extension).otherwise("unknown")


def described(text: Column) -> Column:
    """Struct of the tokens of a colour description such as RGB_D65_SRG_Rel_Lin; gray has no primaries."""
    p = F.split(text, "_")
    gray = p[0] == "Gra"
    at = lambda k: F.get(p, F.lit(k))
    return F.struct(F.when(gray, "gray").otherwise("rgb").alias("space"), at(1).alias("white"), F.when(~gray, at(2)).alias("primaries"), F.when(gray, at(2)).otherwise(at(3)).alias("intent"), F.when(gray, at(3)).otherwise(at(4)).alias("transfer"))

"""Column functions of the scalar library: bit scans, integer helpers, tokens, colour curves, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient that truncates towards zero; exact, unlike a division in doubles."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def pack_signed(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unpack_signed(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u, 1) - 1)


def floor_log2(v: Column) -> Column:
    """Of a positive integer, from its binary digits (no rounding)."""
    return F.length(F.bin(v)) - 1


def ceil_log2(v: Column) -> Column:
    return F.when(v <= 1, 0).otherwise(F.length(F.bin(v - 1)))


def ceil_div(a: Column, b: Column | int) -> Column:
    return div(a + b - 1, b)


def round_up(a: Column, b: int) -> Column:
    return ceil_div(a, b) * b


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    fix = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(v, fix(low)), fix(high))


def shift_left(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n.cast("int"))


def shift_right(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n.cast("int"))


def hybrid_uint(v: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    """Struct (token, n_bits, bits) of a non-negative integer: small values are tokens, others an exponent, some mantissa bits and the rest raw."""
    n = floor_log2(F.greatest(v, F.lit(1)))
    mantissa = v - shift_left(F.lit(1).cast("long"), n)
    token = (1 << split) + shift_left((n - split).cast("long"), F.lit(msb + lsb)) + shift_left(shift_right(mantissa, F.greatest(n - msb, F.lit(0))), F.lit(lsb)) + (mantissa.bitwiseAND(F.lit((1 << lsb) - 1).cast("long")))
    bits = F.greatest(n - msb - lsb, F.lit(0))
    raw = shift_right(v, F.lit(lsb)).bitwiseAND(shift_left(F.lit(1).cast("long"), bits) - 1)
    small = v < (1 << split)
    zero = F.lit(0).cast("long")
    return F.struct(F.when(small, v).otherwise(token).alias("token"), F.when(small, zero).otherwise(bits.cast("long")).alias("n_bits"), F.when(small, zero).otherwise(raw).alias("bits"))


def rct_forward(a: Column, b: Column, c: Column, kind: int) -> tuple[Column, Column, Column]:
    """Reversible colour transform: kind = 7 * permutation + type; type 6 is YCoCg, 0 to 5 subtract the first or a mean."""
    order, custom = divmod(kind, 7)
    planes = (a, b, c)
    first, second, third = planes[order % 3], planes[(order + 1 + order // 3) % 3], planes[(order + 2 - order // 3) % 3]
    if custom == 6:
        co = first - third
        t = third + F.shiftright(co, 1)
        cg = second - t
        return t + F.shiftright(cg, 1), co, cg
    how = custom >> 1
    less = second - first if how == 1 else second - F.shiftright(first + third, 1) if how == 2 else second
    return first, less, third - first if custom & 1 else third


def rct_inverse(a: Column, b: Column, c: Column, kind: int) -> tuple[Column, Column, Column]:
    order, custom = divmod(kind, 7)
    if custom == 6:
        t = a - F.shiftright(c, 1)
        second = c + t
        third = t - F.shiftright(b, 1)
        first = third + b
    else:
        first, third = a, c + a if custom & 1 else c
        how = custom >> 1
        second = b + first if how == 1 else b + F.shiftright(first + third, 1) if how == 2 else b
    out: list[Column] = [first] * 3
    for at, v in zip((order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3), (first, second, third), strict=True):
        out[at] = v
    return out[0], out[1], out[2]


def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def pq_to_linear(x: Column) -> Column:
    """SMPTE ST 2084, 1.0 = 10,000 nits."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(x, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1))


def hlg_to_linear(x: Column) -> Column:
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - c) / a) + b) / 12)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, (b - y) / 1.772, (r - y) / 1.402


def quality_to_distance(q: Column) -> Column:
    return F.when(q >= 100, 0.0).when(q >= 30, 0.1 + (100 - q) * 0.09).otherwise(53.0 / 3000.0 * q * q - 23.0 / 20.0 * q + 25.0)


def unpremultiply(c: Column, alpha: Column, least: float = 1.0 / (1 << 26)) -> Column:
    return c / F.greatest(alpha, F.lit(least))

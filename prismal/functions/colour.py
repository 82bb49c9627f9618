"""Colour conversions between linear RGB, XYB, YCbCr and CMYK, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public image format: absorbance of the three cone types, its inverse, and the bias.
ABSORBANCE = ((0.30, 0.622, 0.078), (0.23, 0.692, 0.078), (0.24342268924547819, 0.20476744424496821, 0.5518098665095536))
ABSORBANCE_INVERSE = ((11.031566901960783, -9.866943921568629, -0.16462299647058826), (-3.254147380392157, 4.418770392156863, -0.16462299647058826), (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863))
BIAS = 0.0037930732552754493


def weighted(weights: tuple[float, ...], *columns: Column) -> Column:
    """Sum of the columns, each times its weight, from the left."""
    out = columns[0] * weights[0]
    for w, c in zip(weights[1:], columns[1:], strict=True):
        out = out + c * w
    return out


def to_xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear RGB (0 to 1) to X, Y and B: cube roots of the biased cone responses, and their half difference and half sum."""
    low = BIAS ** (1 / 3)
    long, medium, short = (F.cbrt(F.greatest(weighted(row, r, g, b) + BIAS, F.lit(0.0))) - low for row in ABSORBANCE)
    return (long - medium) * 0.5, (long + medium) * 0.5, short


def from_xyb(x: Column, y: Column, b: Column) -> tuple[Column, Column, Column]:
    """The inverse of to_xyb."""
    low = BIAS ** (1 / 3)
    cones = tuple((v + low) * (v + low) * (v + low) - BIAS for v in (y + x, y - x, b))
    return tuple(weighted(row, *cones) for row in ABSORBANCE_INVERSE)


def from_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Full-range YCbCr, luma and chroma around zero, to RGB."""
    kr, kb = 0.299, 0.114
    kg = 1 - kr - kb
    red, blue = cr * (2 * (1 - kr)), cb * (2 * (1 - kb))
    return y + red, y - red * (kr / kg) - blue * (kb / kg), y + blue


def ycck_to_cmy(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    """The first three inks of YCCK samples: the complement of their RGB."""
    return tuple(-1.0 / 255 - v for v in from_ycbcr(y, cb, cr))


def fuzzy_class(score: Column, width: float = 4.8, scale: float = 0.7777) -> Column:
    """Class of a distance score: two logistic curves from 2 at no distance to 0, that meet at a score of 1."""
    curve = 2.0 / (1.0 + F.exp((score - 1.0) * width))
    return F.when(score < 1.0, (curve - 1.0) * (2.0 - scale) + scale).otherwise(curve * scale)

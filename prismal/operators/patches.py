"""Patches: rectangles of reference planes laid over planes, in order.

A patch is filed under the tiles of the plane that it touches, so samples meet patches by an equality join on tiles and not by a range join; a
sample inside then meets its source sample by an equality join on its place. What lies on a sample is folded in the order of the patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH = ["img", "k", "x0", "y0", "w", "h", "ref", "rx", "ry", "mode"]


def covered(plane: DataFrame, patches: DataFrame, tile: int = 32) -> DataFrame:
    """img, y, x, v, k, mode, ref, sy, sx: samples of planes under patches (PATCH), with the place in the reference that lies over them."""
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    span = lambda a, n: F.explode(F.when(F.col(n) > 0, F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(a) + F.col(n) - 1) / tile))))
    filed = patches.select(*PATCH).withColumn("ty", span("y0", "h")).withColumn("tx", span("x0", "w"))
    met = plane.select("img", "y", "x", "v", place("y").alias("ty"), place("x").alias("tx")).join(filed, ["img", "ty", "tx"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))
    return met.filter(inside).select("img", "y", "x", "v", "k", "mode", "ref", (F.col("ry") + F.col("y") - F.col("y0")).alias("sy"), (F.col("rx") + F.col("x") - F.col("x0")).alias("sx"))


def laid(below: Column, top: Column, mode: Column) -> Column:
    return F.when(mode == "replace", top).when(mode == "add", below + top).when(mode == "mul", F.round(below * top / 1000.0).cast("long")).otherwise(below)


def overlay(plane: DataFrame, references: DataFrame, patches: DataFrame, tile: int = 32) -> DataFrame:
    """img, y, x, v with all patches laid over it: replace, add, mul (in thousandths) or none. references: ref, y, x, v; a patch ends with its reference."""
    source = references.select("ref", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("top"))
    layers = covered(plane, patches, tile).join(source, ["ref", "sy", "sx"])
    order = layers.groupBy("img", "y", "x").agg(F.array_sort(F.collect_list(F.struct("k", "mode", "top"))).alias("layers"))
    found = plane.select("img", "y", "x", "v").join(order, ["img", "y", "x"], "left")
    folded = F.aggregate("layers", F.col("v"), lambda a, p: laid(a, p["top"], p["mode"]))
    return found.select("img", "y", "x", F.when(F.col("layers").isNull(), F.col("v")).otherwise(folded).alias("v"))

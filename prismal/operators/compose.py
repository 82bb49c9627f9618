"""Layer composition: blend modes and frames composed onto a canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blend(mode: Column, bottom: Column, top: Column, ba: Column, fa: Column, associated: bool = False) -> Column:
    """Colour of top over bottom with alphas in 0..1. Modes: replace, add, mul, blend, alpha_add, none."""
    alpha = 1 - (1 - fa) * (1 - ba)
    over = top + bottom * (1 - fa) if associated else F.when(alpha <= 0, 0.0).otherwise((top * fa + bottom * ba * (1 - fa)) / alpha)
    return F.when(mode == "replace", top).when(mode == "add", bottom + top).when(mode == "mul", bottom * top).when(mode == "blend", over).when(mode == "alpha_add", bottom + top * fa).otherwise(bottom)


def canvas(frames: DataFrame, key: str, order: list[str], mode: str, value: str) -> DataFrame:
    """The canvas after each frame of a key: replace sets it, add adds to it. A fold over the ordered frames."""
    line = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, mode, value))).alias("f"))

    def step(done: Column, x: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0).cast("long"))
        return F.concat(done, F.array(F.when(x[mode] == "replace", x[value]).when(x[mode] == "add", last + x[value]).otherwise(last)))

    folded = line.select(key, "f", F.aggregate("f", F.array().cast("array<bigint>"), step).alias("c"))
    pairs = F.explode(F.arrays_zip("f", "c")).alias("p")
    return folded.select(key, pairs).select(key, *(F.col("p.f")[o].alias(o) for o in order), F.col("p.c").alias("canvas"))


def palette(df: DataFrame, colours: list[str], index: str = "color_id") -> DataFrame:
    """Distinct colours, the most frequent first, ties in colour order; numbered from 0 by a sort of the distinct rows."""
    found = df.groupBy(*colours).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return found.withColumn(index, (F.row_number().over(Window.orderBy(F.desc("n"), *colours)) - 1).cast("long"))

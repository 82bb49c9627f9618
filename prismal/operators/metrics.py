"""Quality metrics over aligned samples and benchmark report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.scalar import ceil_div


def psnr(pairs: DataFrame, group: str, a: str, b: str, peak: float) -> DataFrame:
    """99.99 where nothing differs."""
    sse = F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    found = pairs.groupBy(group).agg(F.count("*").alias("n"), sse.alias("sse"))
    return found.select(group, "n", "sse", F.when(F.col("sse") == 0, 99.99).otherwise(F.round(10 * F.log10(F.lit(peak * peak) * F.col("n") / F.col("sse")), 4)).alias("psnr"))


def p_norm(pairs: DataFrame, group: str, distance: Column, p: float = 3.0) -> DataFrame:
    """Mean of the p, 2p and 4p norms of the distances."""
    norm = lambda q: F.pow(F.avg(F.pow(F.col("_d"), F.lit(q))), F.lit(1.0 / q))
    found = pairs.withColumn("_d", distance).groupBy(group).agg(norm(p).alias("a"), norm(2 * p).alias("b"), norm(4 * p).alias("c"))
    return found.select(group, F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 6).alias("norm"))


def pooled(pairs: DataFrame, group: str, value: Column) -> DataFrame:
    """Mean, and fourth root of the mean fourth power."""
    found = pairs.withColumn("_d", value).groupBy(group).agg(F.avg("_d").alias("m"), F.avg(F.pow("_d", F.lit(4))).alias("q"))
    return found.select(group, F.round("m", 6).alias("mean"), F.round(F.sqrt(F.sqrt("q")), 6).alias("norm4"))


def report(rows: DataFrame, group: str) -> DataFrame:
    """rows: pixels, bytes, seconds, distance. Bits per pixel, megapixels a second, pixel-weighted root mean square of the distance."""
    found = rows.groupBy(group).agg(F.sum("pixels").alias("pixels"), F.sum("bytes").alias("bytes"), F.sum("micros").alias("micros"), F.sum(F.col("distance") * F.col("distance") * F.col("pixels")).alias("d2"))
    return found.select(group, "pixels", "bytes", F.round(F.col("bytes") * 8 / F.col("pixels"), 6).alias("bpp"), F.round(F.col("pixels") / F.col("micros"), 6).alias("mps"), F.round(F.sqrt(F.col("d2") / F.col("pixels")), 6).alias("rms"))


def floor_percentiles(df: DataFrame, group: str, value: str, points: list[int]) -> DataFrame:
    """sorted[floor(q n)], no interpolation. Ranked in a window, so that no group's values meet in one row."""
    w = Window.partitionBy(group)
    ranked = df.select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.groupBy(group).agg(*(F.max(F.when(F.col("k") == F.floor(F.lit(p) * F.col("n") / 100), F.col(value))).alias(f"p{p}") for p in points))


def worst(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median and the values that a tenth and a twentieth are at or over, sorted[floor(q n)]; from two, ten and twenty values on, else null."""
    found = floor_percentiles(df, group, value, [50, 90, 95]).join(df.groupBy(group).agg(F.count("*").alias("n")), group)
    gate = lambda c, least: F.when(F.col("n") >= least, F.col(c))
    return found.select(group, "n", gate("p50", 2).alias("median"), gate("p90", 10).alias("worst10"), gate("p95", 20).alias("worst5"))


def geometric(df: DataFrame, group: str, value: str) -> DataFrame:
    """Geometric mean of the positive values."""
    found = df.groupBy(group).agg(F.avg(F.when(F.col(value) > 0, F.log2(value))).alias("m"), F.count_if(F.col(value) > 0).alias("n"))
    return found.select(group, "n", F.round(F.pow(F.lit(2.0), "m"), 4).alias("geomean"))


def speeds(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """One repetition: itself; two: the second; more: the geometric mean without the first. With least and greatest."""
    w = Window.partitionBy(group)
    ranked = df.select(group, value, F.row_number().over(w.orderBy(*order)).alias("k"), F.count("*").over(w).alias("n"))
    counted = F.when((F.col("n") == 1) | (F.col("k") > 1), F.ln(value))
    found = ranked.groupBy(group).agg(F.max("n").alias("n"), F.avg(counted).alias("m"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(group, "n", F.round(F.exp("m"), 4).alias("speed"), "low", "high")


def tendency(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """kind, central and spread of a group's repetitions: the only one, the second of two, the geometric mean without the first, or, where the first
    to the power of their number leaves 10^100, the median with the root of the squared differences from it."""
    w = Window.partitionBy(group)
    ranked = df.select(group, F.col(value).cast("double").alias("t"), F.row_number().over(w.orderBy(*order)).alias("k"), (F.row_number().over(w.orderBy(value, *order)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    ranked = ranked.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("t"))).over(w))
    found = ranked.groupBy(group).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("k") == 1, F.col("t"))).alias("first"),
        F.max(F.when(F.col("k") == 2, F.col("t"))).alias("second"),
        F.avg(F.when(F.col("k") > 1, F.ln("t"))).alias("logs"),
        F.max("median").alias("median"),
        F.sqrt(F.sum((F.col("t") - F.col("median")) * (F.col("t") - F.col("median")))).alias("spread"),
    )
    kind = F.when(F.col("n") == 1, "only").when(F.col("n") == 2, "second").when(F.col("n") * F.log10("first") < 100, "geomean").otherwise("median")
    central = {"only": "first", "second": "second", "median": "median"}
    picked = F.when(F.col("kind") == "geomean", F.exp("logs"))
    for k, c in central.items():
        picked = picked.when(F.col("kind") == k, F.col(c))
    return found.withColumn("kind", kind).select(group, "n", "kind", F.round(picked, 4).alias("central"), F.round(F.when(F.col("kind") == "median", F.col("spread")).otherwise(0.0), 4).alias("spread"))


def regressions(df: DataFrame, group: str, order: list[str], value: str, percent: float = 5.0) -> DataFrame:
    """Each value against the one before in its group; flagged where it moved over `percent`."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    moved = 100 * (F.col(value) - before) / before
    return df.select(group, *order, value, F.round(moved, 4).alias("moved"), F.coalesce(F.abs(moved) > percent, F.lit(False)).alias("flagged"))


def cfl_slope(df: DataFrame, tile: str, luma: Column, chroma: Column, ridge: float = 0.001) -> DataFrame:
    """Slope of chroma on luma by tile, without intercept, with a ridge term that grows with the tile."""
    found = df.select(tile, luma.alias("a"), chroma.alias("b")).groupBy(tile).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.count("*").alias("n"))
    return found.select(tile, "n", F.round(F.col("ab") / (F.col("aa") + F.col("n") * ridge / 2), 6).alias("slope"))


def section_offsets(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    before = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.select(group, order, size, F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def section_count(groups: Column, dc_groups: Column, passes: Column) -> Column:
    return F.when((groups == 1) & (passes == 1), 1).otherwise(2 + dc_groups + groups * passes)


def tiles_of(pixels: Column, size: int) -> Column:
    return ceil_div(pixels, size)

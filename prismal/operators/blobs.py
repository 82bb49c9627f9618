"""Connected components of the samples of planes that lie over a threshold.

Tiles are labelled on their own, each in one pass of union-find over its samples; samples on the borders of tiles are then joined
with their neighbours beyond, and the labels that meet there are joined up by repeated least-label steps over tables. So a component may
cover any number of tiles, and a task holds a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.tables import forget, written

CELL = ["img", "y", "x"]


def _local(cells: pd.DataFrame) -> pd.DataFrame:
    """Samples of a tile with the least sample (in rows, then columns) of their component in it."""
    places = list(zip(cells["y"].tolist(), cells["x"].tolist(), strict=True))
    parent = {p: p for p in places}

    def top(p: tuple[int, int]) -> tuple[int, int]:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    for y, x in places:
        for other in ((y - 1, x - 1), (y - 1, x), (y - 1, x + 1), (y, x - 1)):
            if other in parent:
                a, b = sorted((top((y, x)), top(other)))
                parent[b] = a
    tops = [top(p) for p in places]
    return cells.assign(ly=[t[0] for t in tops], lx=[t[1] for t in tops])


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for tiles in batches:
        for img, cells in zip(tiles["img"], tiles["cells"], strict=True):
            frame = pd.DataFrame([(c["y"], c["x"], c["v"]) for c in cells], columns=["y", "x", "v"])
            yield _local(frame).assign(img=img)[["img", "y", "x", "v", "ly", "lx"]]


def joined_up(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns node, root: the least node that each node with an edge is joined to.

    Every round gives a node the least root around it, and then the root of its root, so long chains are halved.
    """
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "joined")
    now = written(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        around = both.join(now.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(around, "node").select("node", F.least("root", "near").alias("root"))
        # a root takes the least of what any of its nodes found, so that whole trees move at once
        found = now.join(around, "node").groupBy(F.col("root").alias("old")).agg(F.min("near").alias("best"))
        moved = least.join(found, F.col("root") == F.col("old"), "left").select("node", F.least("root", F.coalesce("best", "root")).alias("root"))
        new = written(moved, "roots")
        changed = new.join(now.withColumnRenamed("root", "was"), "node").filter(F.col("root") != F.col("was")).isEmpty()
        forget(now)
        now = new
        if changed:
            forget(both)
            return now


def components(plane: DataFrame, low: Column | float, tile: int = 64) -> DataFrame:
    """img, y, x, v, label of the samples over `low`; label is the least (y, x) of the component, eight neighbours around a sample."""
    over = plane.filter(F.col("v") > low)
    place = lambda c: F.floor(F.col(c) / tile)
    tiles = over.groupBy("img", place("y").alias("ty"), place("x").alias("tx")).agg(F.collect_list(F.struct("y", "x", "v")).alias("cells")).select("img", "cells")
    local = written(tiles.mapInPandas(_labels, "img long, y long, x long, v long, ly long, lx long"), "labelled")
    name = F.struct("img", "ly", "lx")
    edge = local.filter(F.col("y") % tile == tile - 1).select("img", (F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"), name.alias("u"))
    side = local.filter(F.col("x") % tile == tile - 1).select("img", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), (F.col("x") + 1).alias("x"), name.alias("u"))
    # down and to the left over a corner the other sample has the greater row but lies in the tile before
    back = local.filter(F.col("x") % tile == 0).select("img", (F.col("y") + 1).alias("y"), (F.col("x") - 1).alias("x"), name.alias("u"))
    border = local.filter((F.col("y") % tile == 0) | (F.col("x") % tile == 0) | (F.col("x") % tile == tile - 1)).select(*CELL, name.alias("v"))
    met = edge.union(side).union(back).join(border, CELL).filter("u <> v").select("u", "v").distinct()
    roots = joined_up(met)
    mine = local.withColumn("label", name).join(roots, F.col("label") == F.col("node"), "left")
    found = F.coalesce("root", "label")
    return mine.select(*CELL, "v", F.struct(found["ly"].alias("y"), found["lx"].alias("x")).alias("label"))


def dots(plane: DataFrame, low: int, high: int, window: int = 32, cells: int = 1000, tile: int = 64) -> DataFrame:
    """Components with a sample over `high`, of at most `cells` samples, that fit into a square under `window`: first sample, size, box, peak and sum."""
    found = components(plane, low, tile).groupBy("img", "label").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("v").alias("peak"), F.sum("v").alias("total")
    )
    fits = (F.col("peak") > high) & (F.col("n") <= cells) & (F.col("x1") - F.col("x0") + 1 < window) & (F.col("y1") - F.col("y0") + 1 < window)
    return found.filter(fits).select("img", F.col("label.y").alias("first_y"), F.col("label.x").alias("first_x"), "n", "x0", "x1", "y0", "y1", "peak", "total")

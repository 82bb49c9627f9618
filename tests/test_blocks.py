"""Block transforms, smoothing, gated statistics and wide integers against plain versions."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from prismal.operators import metrics, patches, regions, transforms
from prismal.plans import blocks, catalog


def test_blocks_of_any_size_transform_and_come_back(spark):
    draw = np.random.default_rng(4)
    v = draw.integers(-500, 500, (18, 35))
    df = spark.createDataFrame([(2, y, x, int(v[y, x])) for y, x in itertools.product(range(18), range(35))], "img long, y long, x long, v long").repartition(3)
    for h, w in ((8, 8), (2, 4), (16, 32), (1, 1)):
        found = transforms.forward(transforms.blocks(df, h, w), h, w).cache()
        assert found.count() == (18 // h) * (35 // w)
        ys, xs = np.array(transforms.basis(h)), np.array(transforms.basis(w))
        for r in found.collect():
            assert np.allclose(np.array(r.s).reshape(h, w), ys @ v[r.by * h : (r.by + 1) * h, r.bx * w : (r.bx + 1) * w] @ xs.T)
        for r in transforms.inverse(found, h, w).collect():
            assert np.allclose(np.array(r.s).reshape(h, w), v[r.by * h : (r.by + 1) * h, r.bx * w : (r.bx + 1) * w])


def test_borders_stay_and_flat_planes_do_not_move(spark):
    rows = [(0, y, x, 1.0, 2.0, float(x == 3 and y == 2)) for y in range(5) for x in range(6)]
    found = {(r.y, r.x): r for r in transforms.smoothed(spark.createDataFrame(rows, "img long, y long, x long, v0 double, v1 double, v2 double"), (1.0, 1.0, 2.0)).collect()}
    assert found[0, 0].v2 == 0 and abs(found[2, 3].v0 - 1) < 1e-12
    center = 1 - 4 * (transforms.SIDE + transforms.CORNER)
    assert abs(found[2, 3].v2 - center) < 1e-9 and abs(found[2, 2].v2 - transforms.SIDE) < 1e-9 and abs(found[1, 2].v2 - transforms.CORNER) < 1e-9


def test_gates_and_fallbacks(spark):
    rows = [(g, k, float(k + 1)) for g, n in ((1, 1), (2, 2), (3, 9), (4, 10), (5, 20)) for k in range(n)] + [(6, k, 1e60 + k) for k in range(3)]
    df = spark.createDataFrame(rows, "g long, k long, t double")
    worst = {r.g: (r.median, r.worst10, r.worst5) for r in metrics.worst(df, "g", "t").collect()}
    assert worst[1] == (None, None, None) and worst[2] == (2, None, None) and worst[3] == (5, None, None)
    assert worst[4] == (6, 10, None) and worst[5] == (11, 19, 20)
    kinds = {r.g: (r.kind, r.central) for r in metrics.tendency(df, "g", ["k"], "t").collect()}
    assert kinds[1] == ("only", 1) and kinds[2] == ("second", 2) and kinds[6][0] == "median"
    assert kinds[3] == ("geomean", round(float(np.exp(np.mean(np.log(np.arange(2, 10))))), 4))


def test_var_ints_to_the_greatest_long(spark):
    values = [0, 1, 127, 128, (1 << 53) - 1, (1 << 53) + 1, (1 << 63) - 1, 12345678901234567]
    found = spark.createDataFrame([(v,) for v in values], "v long").select("v", regions.var_int(F.col("v")).alias("b")).collect()
    for r in found:
        assert sum((b & 127) << (7 * i) for i, b in enumerate(r.b)) == r.v
        assert [b >> 7 for b in r.b] == [1] * (len(r.b) - 1) + [0] and (len(r.b) == 1 or r.b[-1])


def test_patches_lie_in_order_and_end_at_borders(spark):
    cells = [(img, y, x, 100 * img + 10 * y + x) for img in (0, 1) for y in range(9) for x in range(9)]
    planes = spark.createDataFrame(cells, "img long, y long, x long, v long").repartition(3)
    laid = [(0, 1, 2, 3, 4, 4, 1, 0, 0, "replace"), (0, 2, 4, 5, 30, 30, 1, 1, 1, "add"), (0, 3, 0, 0, 2, 1, 1, 8, 8, "mul"), (0, 4, 5, 5, 0, 3, 1, 0, 0, "replace"), (1, 0, -2, -1, 4, 3, 0, 0, 0, "replace"), (7, 0, 0, 0, 3, 3, 1, 0, 0, "replace")]
    df = spark.createDataFrame(laid, "img long, k long, x0 long, y0 long, w long, h long, ref long, rx long, ry long, mode string")
    grid = {c[:3]: c[3] for c in cells}
    want = dict(grid)
    for img, _, x0, y0, w, h, ref, rx, ry, mode in sorted(laid, key=lambda p: (p[0], p[1])):
        for y, x in itertools.product(range(y0, y0 + h), range(x0, x0 + w)):
            top = grid.get((ref, ry + y - y0, rx + x - x0))
            if (img, y, x) in want and top is not None:
                v = want[img, y, x]
                want[img, y, x] = top if mode == "replace" else v + top if mode == "add" else round(v * top / 1000)
    found = patches.overlay(planes, planes.withColumnRenamed("img", "ref"), df, 4).collect()
    assert {(r.img, r.y, r.x): r.v for r in found} == want and len(found) == len(cells)


def test_var_ints_of_keys_end_where_those_of_the_sql_do(spark, tmp_path):
    """Up to the greatest key whose number fits 64 bits both agree; one key on both refuse it, and no number is made up."""
    out = {}
    for name, keys in (("fits", [0, 1, 3_036_995]), ("over", [1, 3_036_996])):
        spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/{name}/orders.parquet/*.parquet'")
        out[name] = lambda con=con: con.sql(catalog.ORACLES["var_ints_wide"]).fetchall()
    found = blocks.var_ints_wide(spark, f"{tmp_path}/fits").collect()
    assert sorted(map(tuple, found)) == sorted(out["fits"]())
    with pytest.raises(duckdb.OutOfRangeException):
        out["over"]()
    with pytest.raises(ArithmeticException):
        blocks.var_ints_wide(spark, f"{tmp_path}/over").collect()

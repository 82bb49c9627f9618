"""More registered queries: colour spaces, rectangles, features and reports. Importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.functions import colour as C
from prismal.operators import regions as R
from prismal.plans.catalog import RGB, query, rgb, table

UNIT = f"{RGB}, u AS (SELECT r, g, b, r / 50.0::DOUBLE AS x, g / 10.0::DOUBLE AS y, b / 8.0::DOUBLE AS z FROM rgb)"


def unit(spark, d):
    return rgb(spark, d).select("r", "g", "b", (F.col("r") / 50.0).alias("x"), (F.col("g") / 10.0).alias("y"), (F.col("b") / 8.0).alias("z"))


def _cone(k: int) -> str:
    return " + ".join(f"{w!r}::DOUBLE * {c}" for w, c in zip(C.ABSORBANCE[k], "xyz", strict=True))


LOW = f"pow({C.BIAS!r}::DOUBLE, 1 / 3.0::DOUBLE)"


@query(f"WITH {UNIT}, c AS (SELECT r, g, b, x, y, z, {', '.join(f'cbrt({_cone(k)} + {C.BIAS!r}::DOUBLE) - {LOW} AS {n}' for k, n in enumerate('lms'))} FROM u) SELECT r, g, b, round((l - m) / 2, 6) AS xx, round((l + m) / 2, 6) AS yy, round(s, 6) AS bb, round(x, 4) AS back_r, round(y, 4) AS back_g, round(z, 4) AS back_b FROM c")
def xyb_round_trip(spark, d):
    u = unit(spark, d)
    xyb = C.to_xyb(F.col("x"), F.col("y"), F.col("z"))
    there = u.select("r", "g", "b", *(c.alias(n) for c, n in zip(xyb, ("p", "q", "t"), strict=True)))
    back = C.from_xyb(F.col("p"), F.col("q"), F.col("t"))
    # + 0 turns a negative zero into zero
    return there.select("r", "g", "b", F.round("p", 6).alias("xx"), F.round("q", 6).alias("yy"), F.round("t", 6).alias("bb"), *((F.round(c, 4) + 0.0).alias(f"back_{n}") for c, n in zip(back, "rgb", strict=True)))


@query(f"WITH {UNIT}, v AS (SELECT r, g, b, x + 1.402::DOUBLE * (z - 0.5) AS rr, x - 1.402::DOUBLE * (0.299::DOUBLE / 0.587) * (z - 0.5) - 1.772::DOUBLE * (0.114::DOUBLE / 0.587) * (y - 0.5) AS gg, x + 1.772::DOUBLE * (y - 0.5) AS bb FROM u) SELECT r, g, b, round(rr, 6) AS rr, round(gg, 6) AS gg, round(bb, 6) AS bb, round(-1 / 255.0::DOUBLE - rr, 6) AS c, round(-1 / 255.0::DOUBLE - gg, 6) AS m, round(-1 / 255.0::DOUBLE - bb, 6) AS ye FROM v")
def ycbcr_and_ycck_inverse(spark, d):
    samples = F.col("x"), F.col("y") - 0.5, F.col("z") - 0.5
    out = [*zip(C.from_ycbcr(*samples), ("rr", "gg", "bb"), strict=True), *zip(C.ycck_to_cmy(*samples), ("c", "m", "ye"), strict=True)]
    return unit(spark, d).select("r", "g", "b", *(F.round(c, 6).alias(n) for c, n in out))


@query("SELECT p_partkey, round(CASE WHEN s < 1 THEN (2 / (1 + exp((s - 1) * 4.8::DOUBLE)) - 1) * (2 - 0.7777::DOUBLE) + 0.7777::DOUBLE ELSE 2 / (1 + exp((s - 1) * 4.8::DOUBLE)) * 0.7777::DOUBLE END, 6) AS class FROM (SELECT p_partkey, p_size / 20.0::DOUBLE AS s FROM part)")
def fuzzy_classes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(C.fuzzy_class(F.col("p_size") / 20.0), 6).alias("class"))


RECTS = "rects AS (SELECT p_partkey AS k, p_partkey % 97 AS x, p_partkey % 89 AS y, p_size::BIGINT AS w, p_partkey % 31 AS h FROM part)"


def rects(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), (k % 97).alias("x"), (k % 89).alias("y"), F.col("p_size").cast("long").alias("w"), (k % 31).alias("h"))


@query(f"WITH {RECTS} SELECT k, greatest(x, 20) AS left_, greatest(y, 30) AS top_, greatest(least(x + w, 84) - greatest(x, 20), 0) AS width_, greatest(least(y + h, 94) - greatest(y, 30), 0) AS height_, x >= 20 AND y >= 30 AND x + w <= 84 AND y + h <= 94 AS inside FROM rects")
def rect_membership(spark, d):
    own = tuple(map(F.col, "xywh"))
    frame = tuple(F.lit(v).cast("long") for v in (20, 30, 64, 64))
    both = R.intersection(own, frame)
    return rects(spark, d).select("k", *(c.alias(n) for c, n in zip(both, ("left_", "top_", "width_", "height_"), strict=True)), R.inside(own, frame).alias("inside"))


@query(f"WITH {RECTS}, t AS (SELECT k, unnest(range(y // 16, (y + h - 1) // 16 + 1)) AS ty, x, w FROM rects WHERE h > 0 AND w > 0) SELECT k, ty, unnest(range(x // 16, (x + w - 1) // 16 + 1)) AS tx FROM t")
def rect_tiles(spark, d):
    return R.tiles_touched(rects(spark, d), tuple(map(F.col, "xywh")), 16).select("k", "ty", "tx")


NAMES = "[" + ", ".join(f"'{n}'" for n in R.FEATURES) + "]"


@query(f"SELECT event_id, CASE WHEN event_id % 25 < {len(R.FEATURES)} THEN {NAMES}[event_id % 25 + 1] ELSE 'unknown' END AS feature, CASE WHEN event_id % 4 > 1 THEN 'unsupported' ELSE 'valid' END AS fence FROM events")
def unsupported_features(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 25).alias("c"))
    return R.tagged(e, "c").select("event_id", "feature", R.version_fence(F.col("event_id") % 4).alias("fence"))


FILES = "files AS (SELECT l_returnflag || l_linestatus AS codec, CAST(l_quantity AS BIGINT) * 100 AS pixels, CAST(l_linenumber AS BIGINT) * 37 AS bytes, l_discount * 20 AS distance FROM lineitem)"


def files(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("codec"), (F.col("l_quantity").cast("long") * 100).alias("pixels"), (F.col("l_linenumber").cast("long") * 37).alias("bytes"), (F.col("l_discount") * 20).alias("distance"))


@query(f"WITH {FILES} SELECT codec, count(*) AS files, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(bytes) AS BIGINT) AS bytes, round(sqrt(sum(distance * distance * pixels) / sum(pixels)), 6) AS max_distance, round(sum(bytes) * 8 / sum(pixels), 6) AS bpp, round(sum(bytes * greatest(1, distance)) * 8 / sum(pixels), 6) AS qabpp FROM files GROUP BY codec")
def stats_assimilated(spark, d):
    return R.assimilated(files(spark, d), "codec")


@query("SELECT s || repeat(' ', greatest(1, 12 - length(a)) + greatest(0, 8 - length(s))) || a || repeat(' ', greatest(1, 6 - length(b))) || b AS line FROM (SELECT c_mktsegment AS s, CASE WHEN count(*) > 0 THEN CAST(count(*) AS VARCHAR) ELSE '---' END AS a, CASE WHEN count(*) FILTER (WHERE c_acctbal < -990) > 0 THEN CAST(count(*) FILTER (WHERE c_acctbal < -990) AS VARCHAR) ELSE '---' END AS b FROM customer GROUP BY c_mktsegment)")
def report_lines(spark, d):
    counts = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -990).alias("low"))
    return counts.select(R.report_line(F.col("c_mktsegment"), 8, [(F.col("n"), 12), (F.col("low"), 6)]).alias("line"))


@query("SELECT vec_id, i, round(CAST(embedding[(i % 8) * 8 + i // 8 + 1] AS DOUBLE), 5) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)")
def transposed_blocks(spark, d):
    turned = table(spark, d, "embeddings").select("vec_id", F.posexplode(R.transposed(F.col("embedding"), 8, 8)).alias("i", "v"))
    return turned.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query("SELECT k, array_to_string(list_transform(range(n), lambda i: v // CAST(pow(128, i) AS BIGINT) % 128 + CASE WHEN i < n - 1 THEN 128 ELSE 0 END), ' ') AS bytes FROM (SELECT k, v, greatest(1, CAST(ceil(length(bin(v)) / 7) AS BIGINT)) AS n FROM (SELECT o_orderkey AS k, (o_orderkey * o_custkey) % 5000000 AS v FROM orders))")
def var_ints(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") * F.col("o_custkey")) % 5000000).alias("v"))
    return o.select("k", F.array_join(R.var_int(F.col("v")), " ").alias("bytes"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def trimmed_lists(spark, d):
    text = F.replace("p_type", F.lit(" "), F.lit(" , ,"))
    return table(spark, d, "part").select("p_partkey", F.array_join(R.trimmed_list(text), "|").alias("parts"))

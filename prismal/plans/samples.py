"""More registered queries: samples, frames, dimensions and set operations. Importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismal.functions import samples as S
from prismal.functions.scalar import div
from prismal.operators import planes
from prismal.plans.catalog import NEAR, PAIRS, PLANE, RGB, pairs, plane, query, rgb, table

X = "s AS (SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS x, (p_partkey % 11) / 10.0::DOUBLE AS a FROM part)"


def sized(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_partkey") % 11) / 10.0).alias("a"))


@query(f"WITH {X} SELECT k, round(x * a, 6) AS pre, round(x / greatest(a, 1 / 67108864.0::DOUBLE), 3) AS un, round(x * a + 0.5 * (1 - a), 6) AS flat, round(a * 0.7::DOUBLE * 0.9::DOUBLE + (1 - a * 0.7::DOUBLE) * x, 6) AS spot FROM s")
def alpha_and_spot(spark, d):
    x, a = F.col("x"), F.col("a")
    from prismal.functions.scalar import unpremultiply

    return sized(spark, d).select("k", F.round(S.premultiply(x, a), 6).alias("pre"), F.round(unpremultiply(x, a), 3).alias("un"), F.round(S.flatten(x, a, 0.5), 6).alias("flat"), F.round(S.spot(x, a, 0.9, 0.7), 6).alias("spot"))


@query(f"WITH {RGB} SELECT r, g, b, round(pow(0.2627::DOUBLE * (r / 50.0::DOUBLE) + 0.678::DOUBLE * (g / 10.0::DOUBLE) + 0.0593::DOUBLE * (b / 8.0::DOUBLE), 0.2), 6) AS gain FROM rgb")
def hlg_gain(spark, d):
    return rgb(spark, d).select("r", "g", "b", F.round(S.hlg_gain(F.col("r") / 50.0, F.col("g") / 10.0, F.col("b") / 8.0, 1.2), 6).alias("gain"))


@query(f"WITH {X} SELECT k, CAST(floor(least(greatest(x * 1.1::DOUBLE - 0.05, 0), 1) * 255 + 0.5) AS BIGINT) AS u8, CAST(floor(least(greatest(x * 1.1::DOUBLE - 0.05, 0), 1) * 65535 + 0.5) AS BIGINT) AS u16 FROM s")
def sample_scaling(spark, d):
    x = F.col("x") * 1.1 - 0.05
    return sized(spark, d).select("k", S.to_integer(x, 8).alias("u8"), S.to_integer(x, 16).alias("u16"))


RANKS = "[" + ", ".join(str(v) for line in S.bayer(8) for v in line) + "]"


@query(f"WITH {PLANE} SELECT img, y, x, CAST(least(greatest(floor(abs(v) / 1000.0::DOUBLE * 15 + ({RANKS}[CAST((y % 8) * 8 + x % 8 + 1 AS INTEGER)] + 0.5) / 64), 0), 15) AS BIGINT) AS q FROM plane")
def ordered_dither(spark, d):
    return plane(spark, d).select("img", "y", "x", S.dither(F.abs("v") / 1000.0, F.col("y"), F.col("x"), 4).alias("q"))


@query("SELECT k, CASE WHEN e = 31 THEN NULL WHEN e = 0 THEN s * m * pow(2, -24) ELSE s * (1 + m / 1024.0::DOUBLE) * pow(2, e - 15) END AS v FROM (SELECT p_partkey AS k, CASE WHEN h >= 32768 THEN -1 ELSE 1 END AS s, h // 1024 % 32 AS e, h % 1024 AS m FROM (SELECT p_partkey, (p_partkey * 7919) % 65536 AS h FROM part))")
def half_floats(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.half((F.col("p_partkey") * 7919) % 65536).alias("v"))


ORD = "CAST(unicode(substr(p_brand, {k}, 1)) AS BIGINT)"


@query(f"SELECT p_partkey AS k, {ORD.format(k=1)} * 256 + {ORD.format(k=2)} AS be16, {ORD.format(k=1)} + {ORD.format(k=2)} * 256 AS le16, {ORD.format(k=1)} + {ORD.format(k=2)} * 256 + {ORD.format(k=3)} * 65536 + {ORD.format(k=4)} * 16777216 AS le32 FROM part")
def endian_loads(spark, d):
    b = F.encode("p_brand", "UTF-8")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.load_be(b, 1, 2).alias("be16"), S.load_le(b, 1, 2).alias("le16"), S.load_le(b, 1, 4).alias("le32"))


@query("SELECT o_orderkey, lpad(CAST(f // 24 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // 24 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // 24 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f % 24 AS VARCHAR), 2, '0') AS code FROM (SELECT o_orderkey, o_custkey * 137 % 2000000 AS f FROM orders)")
def timecodes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.timecode((F.col("o_custkey") * 137) % 2000000, 24).alias("code"))


@query("SELECT user_id, event_id, CAST(coalesce(sum(t) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ticks, t AS ticks FROM (SELECT user_id, ts, event_id, event_id % 7 + 1 AS t FROM events)")
def frame_ticks(spark, d):
    t = F.col("event_id") % 7 + 1
    before = F.sum(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce(before, F.lit(0)).cast("long").alias("start_ticks"), t.alias("ticks"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k > 3")
def skip_frames(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("k", k).filter("k > 3").select("user_id", "event_id")


@query("SELECT doc_id, CAST((n_chars > 100)::INT + (n_chars > 500)::INT + (n_chars > 1000)::INT + (n_chars > 5000)::INT AS BIGINT) AS bucket FROM documents")
def context_buckets(spark, d):
    return table(spark, d, "documents").select("doc_id", S.bucket(F.col("n_chars"), [100, 500, 1000, 5000]).alias("bucket"))


@query("WITH m AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) % 4 AS cluster FROM documents GROUP BY source) SELECT lang, cluster, count(*) AS n FROM documents JOIN m USING (source) GROUP BY ALL")
def context_map_lookup(spark, d):
    from prismal.operators.symbols import reindex

    docs = table(spark, d, "documents")
    m = reindex(docs, "source", "doc_id").select(F.col("label").alias("source"), ((F.col("id") + 1) % 4).alias("cluster"))
    return docs.join(m, "source").groupBy("lang", "cluster").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def used_histograms(spark, d):
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(used, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT l_orderkey, count(DISTINCT {'f': l_returnflag, 's': l_linestatus}) = 1 AS equal FROM lineitem GROUP BY l_orderkey")
def channel_set_equality(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_returnflag", "l_linestatus") == 1).alias("equal"))


@query("SELECT 'part' AS box, p_partkey AS id, p_name AS contents FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def metadata_union(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("box"), F.col(f"{c}key" if t != "supplier" else "s_suppkey").alias("id"), F.col(f"{c[0]}_name").alias("contents"))
    return one("part", "p_part").unionByName(one("supplier", "s_supp")).unionByName(one("customer", "c_cust"))


@query(f"WITH {PLANE} SELECT x, count(*) FILTER (WHERE v // 50 <> 0) AS nonzero, CAST(sum(abs(v // 50)) AS BIGINT) AS total FROM plane GROUP BY x")
def laplacian_stats(spark, d):
    q = div(F.col("v"), 50)
    return plane(spark, d).groupBy("x").agg(F.count_if(q != 0).alias("nonzero"), F.sum(F.abs(q)).alias("total"))


@query(f"WITH {PAIRS} SELECT codec, max(abs(a - b)) AS worst, round(sqrt(avg(CAST((a - b) * (a - b) AS DOUBLE))), 3) AS rmse, max(abs(a - b)) <= 1000000 AND sqrt(avg(CAST((a - b) * (a - b) AS DOUBLE))) <= 250000 AS passes FROM pairs GROUP BY codec")
def comparator_limits(spark, d):
    diff = F.abs(F.col("a") - F.col("b"))
    rmse = F.sqrt(F.avg((diff * diff).cast("double")))
    return pairs(spark, d).groupBy("codec").agg(F.max(diff).alias("worst"), F.round(rmse, 3).alias("rmse"), ((F.max(diff) <= 1000000) & (rmse <= 250000)).alias("passes"))


@query(f"WITH {PLANE}, {NEAR} SELECT img, y, x, list_sort([l, t, tl, tr, ll, tt, trr])[1] AS k1, list_sort([l, t, tl, tr, ll, tt, trr])[2] AS k2, list_sort([l, t, tl, tr, ll, tt, trr])[3] AS k3 FROM near")
def smallest_neighbours(spark, d):
    s = F.slice(F.sort_array(F.array("l", "t", "tl", "tr", "ll", "tt", "trr")), 1, 3)
    return planes.neighbours(plane(spark, d)).select("img", "y", "x", s.alias("s")).select("img", "y", "x", *(F.col("s")[k].alias(f"k{k + 1}") for k in range(3)))


@query(f"WITH {PLANE} SELECT img, ty, tx, row_number() OVER (PARTITION BY img ORDER BY greatest(abs(2 * ty - h), abs(2 * tx - 7)), ty, tx) - 1 AS place FROM (SELECT img, ty, tx, max(ty) OVER (PARTITION BY img) AS h FROM (SELECT DISTINCT img, y // 8 AS ty, x // 8 AS tx FROM plane))")
def group_order(spark, d):
    tiles = planes.tile_stats(plane(spark, d)).withColumn("h", F.max("ty").over(Window.partitionBy("img")))
    far = F.greatest(F.abs(2 * F.col("ty") - F.col("h")), F.abs(2 * F.col("tx") - 7))
    return tiles.select("img", "ty", "tx", (F.row_number().over(Window.partitionBy("img").orderBy(far, "ty", "tx")) - 1).cast("long").alias("place"))


@query("SELECT page_id, CASE WHEN e IN ('jpg', 'jpeg') THEN 'jpeg' WHEN e IN ('pgm', 'ppm', 'pfm', 'pam', 'pnm') THEN 'pnm' WHEN e IN ('png', 'apng') THEN 'png' WHEN e IN ('gif', 'exr', 'pgx', 'jxl', 'npy') THEN e ELSE 'unknown' END AS codec FROM (SELECT page_id, ['jpg', 'ppm', 'png', 'jxl', 'txt'][1 + page_id % 5] AS e FROM pages)")
def codec_detection(spark, d):
    extension = F.element_at(F.array(*map(F.lit, (".jpg", ".PPM", ".png", ".jxl", ".txt"))), (1 + F.col("page_id") % 5).cast("int"))
    return table(spark, d, "pages").select("page_id", S.codec_of(F.concat(F.lit("/a.b/c"), extension)).alias("codec"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'rgb' ELSE 'gray' END AS space, 'D65' AS white, CASE WHEN p_partkey % 2 = 0 THEN 'SRG' END AS primaries, 'Rel' AS intent, CASE WHEN p_partkey % 2 = 0 THEN 'Lin' ELSE 'SRG' END AS transfer FROM part")
def colour_descriptions(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, "RGB_D65_SRG_Rel_Lin").otherwise("Gra_D65_Rel_SRG")
    return table(spark, d, "part").select("p_partkey", S.described(text).alias("c")).select("p_partkey", "c.*")


@query("SELECT event_type AS key, user_id % 10 AS part, count(*) AS n FROM events GROUP BY ALL")
def stat_counters(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("key"), (F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {RGB} SELECT r, round((6 * sum(CAST(g * g AS DOUBLE)) + sum(CAST(b * b AS DOUBLE)) + sum(CAST(r * r AS DOUBLE))) / 8 / count(*), 6) AS distance FROM rgb GROUP BY r")
def weighted_distance(spark, d):
    sq = lambda c: F.sum((F.col(c) * F.col(c)).cast("double"))
    return rgb(spark, d).groupBy(F.col("r").alias("k")).agg(sq("g").alias("sg"), sq("b").alias("sb"), sq("r").alias("sr"), F.count("*").alias("n")).select(F.col("k").alias("r"), F.round((6 * F.col("sg") + F.col("sb") + F.col("sr")) / 8 / F.col("n"), 6).alias("distance"))


@query(f"WITH {PLANE} SELECT img, y, x, CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 0 WHEN x % 8 + y % 8 <= 3 THEN 1 ELSE 2 END AS pass, v FROM plane")
def progressive_split(spark, d):
    bx, by = F.col("x") % 8, F.col("y") % 8
    return plane(spark, d).select("img", "y", "x", F.when((bx == 0) & (by == 0), 0).when(bx + by <= 3, 1).otherwise(2).alias("pass"), "v")

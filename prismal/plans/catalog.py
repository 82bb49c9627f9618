"""Registered queries over the carrier tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.functions import scalar as S
from prismal.operators import compose, metrics, planes, symbols, trees, verdicts
from prismal.sources import containers
from prismal.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLANE = "plane AS (SELECT img, y, x, CAST(round(CAST(embedding[x + 1] AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT CAST(label AS BIGINT) AS img, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings), (SELECT unnest(range(64)) AS x))"
NEAR = """n1 AS (SELECT *, lag(v) OVER c AS t0, lag(v, 2) OVER c AS tt0 FROM plane WINDOW c AS (PARTITION BY img, x ORDER BY y)),
n2 AS (SELECT *, lag(v) OVER r AS l0, lag(v, 2) OVER r AS ll0, lag(t0) OVER r AS tl0, lead(t0) OVER r AS tr0, lead(t0, 2) OVER r AS trr0 FROM n1 WINDOW r AS (PARTITION BY img, y ORDER BY x)),
near AS (SELECT img, y, x, v, coalesce(l0, t0, 0) AS l, coalesce(t0, l0, 0) AS t, coalesce(tl0, l0, t0, 0) AS tl, coalesce(tr0, t0, l0, 0) AS tr, coalesce(ll0, l0, t0, 0) AS ll, coalesce(tt0, t0, l0, 0) AS tt, coalesce(trr0, tr0, t0, l0, 0) AS trr FROM n2)"""
SYMBOLS = "symbols AS (SELECT doc_id AS key, lang AS ctx, i AS pos, CAST(unicode(substr(text, i + 1, 1)) AS BIGINT) AS sym FROM (SELECT *, unnest(range(length(text))) AS i FROM documents))"
HIST = f"{SYMBOLS}, hist AS (SELECT ctx, sym, count(*) AS n FROM symbols GROUP BY ctx, sym), tot AS (SELECT ctx, sum(n) AS t FROM hist GROUP BY ctx)"
SHORT = "short AS (SELECT doc_id AS key, i AS pos, CAST(unicode(substr(source, i + 1, 1)) AS BIGINT) AS sym FROM (SELECT *, unnest(range(length(source))) AS i FROM (SELECT doc_id, source || ':' || repeat(lang, 3) AS source FROM documents)))"
RGB = "rgb AS (SELECT DISTINCT CAST(round(l_quantity) AS BIGINT) AS r, CAST(round(l_discount * 100) AS BIGINT) AS g, CAST(round(l_tax * 100) AS BIGINT) AS b FROM lineitem)"
PAIRS = "pairs AS (SELECT l_returnflag || l_linestatus AS codec, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS b, l_shipdate, l_quantity FROM lineitem)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def plane(spark: SparkSession, d: str) -> DataFrame:
    return planes.from_arrays(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def stream(spark: SparkSession, d: str) -> DataFrame:
    return symbols.of_text(table(spark, d, "documents"), "doc_id", "lang", "text")


def hist(spark: SparkSession, d: str) -> DataFrame:
    return symbols.histogram(stream(spark, d))


def short(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("c"), F.concat("source", F.lit(":"), F.repeat("lang", F.lit(3))).alias("s"))
    return symbols.of_text(docs, "doc_id", "c", "s").drop("ctx")


def rgb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.round("l_quantity").cast("long").alias("r"), F.round(F.col("l_discount") * 100).cast("long").alias("g"), F.round(F.col("l_tax") * 100).cast("long").alias("b")).distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    price, less = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("codec"), F.round(price * 100).cast("long").alias("a"), F.round(price * less * 100).cast("long").alias("b"), "l_shipdate", "l_quantity")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- projections


@query(f"WITH {PLANE} SELECT img, y, x, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS u, v AS back FROM plane")
def pack_signed(spark, d):
    p = plane(spark, d).withColumn("u", S.pack_signed(F.col("v")))
    return p.select("img", "y", "x", "u", S.unpack_signed(F.col("u")).alias("back"))


HYBRID = "u < 16 OR u IS NULL"


@query(f"""WITH {PLANE}, p AS (SELECT img, y, x, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS u FROM plane),
q AS (SELECT *, length(bin(greatest(u, 1))) - 1 AS n FROM p)
SELECT img, y, x, CAST(CASE WHEN u < 16 THEN u ELSE 16 + (n - 4) * 4 + ((u - (1 << n)) // (1 << (n - 2))) END AS BIGINT) AS token, CAST(CASE WHEN u < 16 THEN 0 ELSE n - 2 END AS BIGINT) AS n_bits,
CAST(CASE WHEN u < 16 THEN 0 ELSE u % (1 << greatest(n - 2, 0)) END AS BIGINT) AS bits FROM q""")
def hybrid_uint_tokens(spark, d):
    return plane(spark, d).withColumn("h", S.hybrid_uint(S.pack_signed(F.col("v")))).select("img", "y", "x", "h.*")


def _rct_sql() -> str:
    parts = []
    for kind in range(42):
        order, custom = divmod(kind, 7)
        cols = ("r", "g", "b")
        f, s, t = cols[order % 3], cols[(order + 1 + order // 3) % 3], cols[(order + 2 - order // 3) % 3]
        if custom == 6:
            co = f"({f} - {t})"
            tmp = f"({t} + ({co} >> 1))"
            out = (f"{tmp} + (({s} - {tmp}) >> 1)", co, f"{s} - {tmp}")
        else:
            out = (f, {0: s, 1: f"{s} - {f}", 2: f"{s} - (({f} + {t}) >> 1)"}[custom >> 1], f"{t} - {f}" if custom & 1 else t)
        parts.append(f"SELECT CAST({kind} AS BIGINT) AS kind, r, g, b, {out[0]} AS c0, {out[1]} AS c1, {out[2]} AS c2, r AS r2, g AS g2, b AS b2 FROM rgb")
    return f"WITH {RGB} " + " UNION ALL ".join(parts)


@query(_rct_sql())
def rct_all_kinds(spark, d):
    base = rgb(spark, d)
    each = []
    for kind in range(42):
        c = S.rct_forward(F.col("r"), F.col("g"), F.col("b"), kind)
        each.append(F.struct(F.lit(kind).cast("long").alias("kind"), *(x.alias(f"c{k}") for k, x in enumerate(c))))
    long = base.select("r", "g", "b", F.explode(F.array(*each)).alias("e")).select("r", "g", "b", "e.*")
    back = [S.rct_inverse(F.col("c0"), F.col("c1"), F.col("c2"), k) for k in range(42)]
    pick = lambda i: F.element_at(F.array(*(x[i] for x in back)), F.col("kind").cast("int") + 1)
    return long.select("kind", "r", "g", "b", "c0", "c1", "c2", pick(0).alias("r2"), pick(1).alias("g2"), pick(2).alias("b2"))


@query("""SELECT p_partkey, round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END, 6) AS srgb, round(CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 6) AS hlg,
round(pow(greatest(pow(x, 1 / (2523.0 / 4096 * 128)) - 3424.0 / 4096, 0) / (2413.0 / 4096 * 32 - 2392.0 / 4096 * 32 * pow(x, 1 / (2523.0 / 4096 * 128))), 1 / (2610.0 / 16384)), 6) AS pq,
round(CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END, 6) AS from_linear FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)""")
def transfer_curves(spark, d):
    x = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(S.srgb_to_linear(x), 6).alias("srgb"), F.round(S.hlg_to_linear(x), 6).alias("hlg"), F.round(S.pq_to_linear(x), 6).alias("pq"), F.round(S.linear_to_srgb(x), 6).alias("from_linear"))


@query("SELECT p_partkey, round(CASE WHEN q >= 100 THEN 0 WHEN q >= 30 THEN 0.1 + (100 - q) * 0.09 ELSE 53.0 / 3000.0 * q * q - 23.0 / 20.0 * q + 25 END, 6) AS distance FROM (SELECT p_partkey, p_size * 2.0::DOUBLE AS q FROM part)")
def quality_to_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.quality_to_distance(F.col("p_size") * 2.0), 6).alias("distance"))


@query(f"WITH {RGB} SELECT r, g, b, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS y, round((b - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)) / 1.772::DOUBLE, 6) AS cb, round((r - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)) / 1.402::DOUBLE, 6) AS cr FROM rgb")
def rgb_to_ycbcr(spark, d):
    y, cb, cr = S.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("r", "g", "b", F.round(y, 6).alias("y"), F.round(cb, 6).alias("cb"), F.round(cr, 6).alias("cr"))


@query("SELECT o_orderkey, CAST((n + 6) // 7 AS BIGINT) AS ceil_div, CAST((n + 6) // 7 * 7 AS BIGINT) AS round_up, CAST(length(bin(n)) - 1 AS BIGINT) AS floor_log2, CAST(CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END AS BIGINT) AS ceil_log2, least(greatest(n, 1000), 5000) AS clamped, CAST(bit_count(n) AS BIGINT) AS ones FROM (SELECT o_orderkey, o_custkey AS n FROM orders)")
def integer_helpers(spark, d):
    n = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", S.ceil_div(n, 7).alias("ceil_div"), S.round_up(n, 7).alias("round_up"), S.floor_log2(n).cast("long").alias("floor_log2"), S.ceil_log2(n).cast("long").alias("ceil_log2"), S.clamp(n, 1000, 5000).alias("clamped"), F.bit_count(n).cast("long").alias("ones"))


# ---- windows over planes

PREDICTORS = {
    "zero": "0",
    "left": "l",
    "top": "t",
    "average0": "(l + t) // 2",
    "average1": "(l + tl) // 2",
    "average2": "(tl + t) // 2",
    "average3": "(t + tr) // 2",
    "average4": "(6 * t - 2 * tt + 7 * l + ll + trr + 3 * tr + 8) // 16",
    "select": "CASE WHEN abs(t - tl) < abs(l - tl) THEN l ELSE t END",
    "gradient": "CASE WHEN tl < least(l, t) THEN greatest(l, t) WHEN tl > greatest(l, t) THEN least(l, t) ELSE l + t - tl END",
    "top_left": "tl",
    "top_right": "tr",
    "left_left": "ll",
}


@query(f"WITH {PLANE}, {NEAR} SELECT img, y, x, v, " + ", ".join(f"CAST({s} AS BIGINT) AS \"{n}\"" for n, s in PREDICTORS.items()) + " FROM near")
def predictors(spark, d):
    return planes.predict(plane(spark, d), list(PREDICTORS))


UNPIVOTED = " UNION ALL ".join(f"SELECT '{n}' AS predictor, img, y, x, v - ({s}) AS e FROM near" for n, s in PREDICTORS.items())


@query(f"""WITH {PLANE}, {NEAR}, r AS ({UNPIVOTED}), h AS (SELECT predictor, e, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT predictor, sum(n) AS total FROM h GROUP BY predictor)
SELECT predictor, CAST(max(total) AS BIGINT) AS total, round(sum(n * log2(total / n)), 3) AS bits FROM h JOIN t USING (predictor) GROUP BY predictor""")
def residual_entropy_by_predictor(spark, d):
    found = planes.predict(plane(spark, d), list(PREDICTORS))
    long = found.select("v", F.explode(F.create_map(*(x for n in PREDICTORS for x in (F.lit(n), F.col(n))))).alias("ctx", "p")).select("ctx", (F.col("v") - F.col("p")).alias("sym"))
    h = symbols.histogram(long)
    total = h.groupBy("ctx").agg(F.sum("n").alias("total"))
    return h.join(total, "ctx").groupBy(F.col("ctx").alias("predictor")).agg(F.max("total").alias("total"), F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))), 3).alias("bits"))


@query(f"""WITH {PLANE}, {NEAR}, r AS ({UNPIVOTED}), s AS (SELECT img, y // 8 AS ty, x // 8 AS tx, predictor, sum(abs(e)) AS cost FROM r GROUP BY ALL)
SELECT img, ty, tx, predictor, CAST(cost AS BIGINT) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY img, ty, tx ORDER BY cost, predictor) AS k FROM s) WHERE k = 1""")
def best_predictor_per_tile(spark, d):
    found = planes.predict(plane(spark, d), list(PREDICTORS))
    sums = found.groupBy("img", S.div(F.col("y"), 8).alias("ty"), S.div(F.col("x"), 8).alias("tx")).agg(*(F.sum(F.abs(F.col("v") - F.col(n))).alias(n) for n in PREDICTORS))
    least = F.array_min(F.array(*(F.struct(F.col(n).alias("cost"), F.lit(n).alias("predictor")) for n in PREDICTORS)))
    return sums.select("img", "ty", "tx", least.alias("b")).select("img", "ty", "tx", "b.predictor", "b.cost")


TEND = """CASE WHEN lf >= a AND a >= nx THEN CASE WHEN dn2 + (dn2 % 2) > 2 * (a - nx) THEN 2 * (a - nx) ELSE dn2 END
WHEN lf <= a AND a <= nx THEN CASE WHEN up2 - abs(up2 % 2) < 2 * (a - nx) THEN 2 * (a - nx) ELSE up2 END ELSE 0 END"""


@query(f"""WITH {PLANE}, p AS (SELECT img, y, x // 2 AS k, max(v) FILTER (WHERE x % 2 = 0) AS a0, max(v) FILTER (WHERE x % 2 = 1) AS b0 FROM plane GROUP BY ALL),
q AS (SELECT *, (a0 + b0 + CASE WHEN a0 > b0 THEN 1 ELSE 0 END) >> 1 AS a FROM p), w AS (SELECT *, coalesce(lag(b0) OVER r, a) AS lf, coalesce(lead(a) OVER r, a) AS nx FROM q WINDOW r AS (PARTITION BY img, y ORDER BY k)),
u AS (SELECT *, (4 * lf - 3 * nx - a + 6) // 12 AS dn, (4 * lf - 3 * nx - a - 6) // 12 AS up FROM w),
z AS (SELECT *, CASE WHEN dn - (dn % 2) > 2 * (lf - a) THEN 2 * (lf - a) + 1 ELSE dn END AS dn2, CASE WHEN up + abs(up % 2) < 2 * (lf - a) THEN 2 * (lf - a) - 1 ELSE up END AS up2 FROM u)
SELECT img, y, k, a AS avg, CAST(a0 - b0 - ({TEND}) AS BIGINT) AS residual FROM z""")
def squeeze_forward(spark, d):
    return planes.squeeze(plane(spark, d))


@query(f"WITH {PLANE} SELECT img, y, x, v FROM plane")
def squeeze_round_trip(spark, d):
    return planes.unsqueeze(planes.squeeze(plane(spark, d)))


@query(f"WITH {PLANE} SELECT img, y // 8 AS ty, x // 8 AS tx, count(*) AS n, min(v) AS low, max(v) AS high, CAST(sum(v) AS BIGINT) AS total FROM plane GROUP BY ALL")
def planar_group_summary(spark, d):
    return planes.tile_stats(plane(spark, d))


@query(f"WITH {PLANE} SELECT img, y // 8 AS ty, x // 8 AS tx, round(pow(avg(pow(abs(v) / 1000.0::DOUBLE, 4)), 0.25), 6) AS norm FROM plane GROUP BY ALL")
def tile_norm(spark, d):
    return planes.tile_norm(plane(spark, d))


@query(f"""WITH {PLANE}, h AS (SELECT img, max(y) + 1 AS h FROM plane GROUP BY img) """ + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS kind, img, {y} AS y, {x} AS x, v FROM plane JOIN h USING (img)" for k, (y, x) in {1: ("y", "x"), 2: ("y", "63 - x"), 3: ("h - 1 - y", "63 - x"), 4: ("h - 1 - y", "x"), 5: ("x", "y"), 6: ("x", "h - 1 - y"), 7: ("63 - x", "h - 1 - y"), 8: ("63 - x", "y")}.items()))
def orientations(spark, d):
    p = plane(spark, d)
    sized = p.join(p.groupBy("img").agg((F.max("y") + 1).alias("h")), "img")
    out = None
    for k in range(1, 9):
        one = planes.orient(sized, k, 64, F.col("h")).select(F.lit(k).cast("long").alias("kind"), "img", "y", "x", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PLANE} SELECT img, y, x, v FROM plane WHERE x < 40 AND y < 20")
def crop(spark, d):
    return plane(spark, d).filter((F.col("x") < 40) & (F.col("y") < 20))


@query(f"""WITH {PLANE}, s AS (SELECT *, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) AS s FROM plane WINDOW r AS (PARTITION BY img, y ORDER BY x))
SELECT img, y, x, 4 * v + 2 * (s + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v)) + coalesce(lag(s) OVER c, s) + coalesce(lead(s) OVER c, s) AS v FROM s WINDOW c AS (PARTITION BY img, x ORDER BY y)""")
def symmetric_filter(spark, d):
    return planes.symmetric3(plane(spark, d), 4, 2, 1)


@query(f"""WITH {PLANE}, s AS (SELECT *, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS n FROM plane WINDOW r AS (PARTITION BY img, y ORDER BY x))
SELECT img, y, 2 * x AS x, (3 * v + l) // 4 AS v FROM s UNION ALL SELECT img, y, 2 * x + 1, (3 * v + n) // 4 FROM s""")
def chroma_upsampling(spark, d):
    return planes.upsample_chroma(plane(spark, d))


BASIS = "basis AS (SELECT u, i, CASE WHEN u = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END * sqrt(2.0 / 8) * cos((2 * i + 1) * u * pi() / 16) AS c FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS i))"


@query(f"WITH {PLANE}, {BASIS} SELECT img, y, x // 8 AS b, CAST(u AS INTEGER) AS u, round(sum(v * c), 3) + 0.0 AS coefficient FROM plane JOIN basis ON i = x % 8 GROUP BY ALL")
def dct8_forward(spark, d):
    return planes.dct_rows(plane(spark, d)).withColumn("coefficient", F.round("coefficient", 3) + 0.0)


@query(f"WITH {PLANE} SELECT img, y, x, v FROM plane")
def dct8_round_trip(spark, d):
    return planes.inverse_dct_rows(planes.dct_rows(plane(spark, d)))


@query(f"WITH {PLANE}, z AS (SELECT x, sum(CASE WHEN abs(v) < 50 THEN 1 ELSE 0 END) AS zeros FROM plane GROUP BY x) SELECT x, CAST(zeros AS BIGINT) AS zeros, row_number() OVER (ORDER BY zeros, x) - 1 AS place FROM z")
def coefficient_order(spark, d):
    from pyspark.sql import Window

    z = plane(spark, d).groupBy("x").agg(F.count_if(F.abs("v") < 50).alias("zeros"))
    return z.select("x", "zeros", (F.row_number().over(Window.orderBy("zeros", "x")) - 1).cast("long").alias("place"))


@query(f"WITH {PLANE} SELECT img, y, x, CAST(round(v / (10.0::DOUBLE + x)) AS BIGINT) AS q, CAST(round(v / (10.0::DOUBLE + x)) AS BIGINT) * (10 + x) AS back FROM plane")
def quantize(spark, d):
    q = F.round(F.col("v") / (10.0 + F.col("x"))).cast("long")
    return plane(spark, d).select("img", "y", "x", q.alias("q"), (q * (10 + F.col("x"))).alias("back"))


# ---- symbols


@query(f"WITH {HIST} SELECT ctx, sym, n FROM hist")
def symbol_histogram(spark, d):
    return hist(spark, d)


@query(f"WITH {HIST} SELECT ctx, CAST(max(t) AS BIGINT) AS total, round(sum(n * log2(t / n)), 4) AS bits FROM hist JOIN tot USING (ctx) GROUP BY ctx")
def context_entropy(spark, d):
    return symbols.entropy(hist(spark, d))


@query(f"WITH {HIST} SELECT ctx, max(sym) + 1 AS size, count(*) AS used FROM hist GROUP BY ctx")
def alphabet_size(spark, d):
    return symbols.alphabet(hist(spark, d))


PAIRED = f"""{HIST}, pr AS (SELECT a.ctx AS a, b.ctx AS b, a.t AS ta, b.t AS tb FROM tot a JOIN tot b ON a.ctx < b.ctx), sy AS (SELECT DISTINCT sym FROM hist),
f AS (SELECT a, b, ta, tb, coalesce(x.n, 0) AS na, coalesce(z.n, 0) AS nb FROM pr CROSS JOIN sy LEFT JOIN hist x ON x.ctx = a AND x.sym = sy.sym LEFT JOIN hist z ON z.ctx = b AND z.sym = sy.sym)"""


@query(f"WITH {PAIRED} SELECT a, b, round(sum(CASE WHEN na + nb > 0 THEN (na + nb) * log2((ta + tb) / (na + nb)) ELSE 0 END - CASE WHEN na > 0 THEN na * log2(ta / na) ELSE 0 END - CASE WHEN nb > 0 THEN nb * log2(tb / nb) ELSE 0 END), 3) AS distance FROM f GROUP BY a, b")
def histogram_merge_distance(spark, d):
    return symbols.merge_distance(hist(spark, d))


@query(f"WITH {PAIRED} SELECT a, b, bool_or(na > 0 AND nb = 0) AS infinite, CASE WHEN bool_or(na > 0 AND nb = 0) THEN -1 ELSE round(sum(CASE WHEN na > 0 THEN na * log2(tb / greatest(nb, 1)) - na * log2(ta / na) ELSE 0 END), 3) END AS kl FROM f GROUP BY a, b")
def histogram_kl(spark, d):
    return symbols.kl(hist(spark, d))


@query(f"""WITH {SYMBOLS}, e AS (SELECT *, CASE WHEN lag(sym) OVER w = sym THEN 0 ELSE 1 END AS c FROM symbols WINDOW w AS (PARTITION BY key ORDER BY pos)), r AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY pos) AS run FROM e),
g AS (SELECT key, run, min(pos) AS start, min(sym) AS sym, count(*) AS length FROM r GROUP BY key, run) SELECT key, start, sym, length, CAST(CASE WHEN length <= 1 THEN 0 ELSE length(bin(length - 1)) END AS BIGINT) AS cost FROM g""")
def rle_runs(spark, d):
    return symbols.text_runs(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH {SHORT}, p AS (SELECT *, max(pos) OVER (PARTITION BY key, sym ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM short)
SELECT p.key, p.pos, CASE WHEN last IS NULL THEN -1 ELSE (SELECT count(DISTINCT s.sym) FROM short s WHERE s.key = p.key AND s.pos > p.last AND s.pos < p.pos) END AS index FROM p""")
def move_to_front(spark, d):
    return symbols.move_to_front(short(spark, d))


@query()
def move_to_front_texts(spark, d):
    return symbols.move_to_front_texts(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT source AS label, f AS first, row_number() OVER (ORDER BY f, source) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def canonical_reindex(spark, d):
    return symbols.reindex(table(spark, d, "documents"), "source", "doc_id")


@query()
def huffman_codes(spark, d):
    return symbols.huffman(hist(spark, d))


@query()
def ans_round_trip(spark, d):
    return symbols.ans_round_trip_texts(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
SELECT a.g AS o_custkey, CAST(a.k AS BIGINT) AS pos, count(b.k) AS digit FROM o a LEFT JOIN o b ON a.g = b.g AND b.k > a.k AND b.v < a.v GROUP BY a.g, a.k""")
def lehmer_digits(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey")
    found = symbols.lehmer(o, "o_custkey", "at", "o_orderkey")
    return found.select("o_custkey", F.col("pos").cast("long").alias("pos"), F.col("digit").cast("long").alias("digit"))


@query("SELECT source, doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def section_offsets(spark, d):
    return metrics.section_offsets(table(spark, d, "documents"), "source", "doc_id", "n_chars")


@query("SELECT user_id, n, CASE WHEN g = 1 AND p = 1 THEN 1 ELSE 2 + dc + g * p END AS sections FROM (SELECT user_id, count(*) AS n, (count(*) + 3) // 4 AS g, (count(*) + 31) // 32 AS dc, count(DISTINCT event_type) AS p FROM events GROUP BY user_id)")
def section_counts(spark, d):
    found = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("p"))
    return found.select("user_id", "n", metrics.section_count(S.ceil_div(F.col("n"), 4), S.ceil_div(F.col("n"), 32), F.col("p")).alias("sections"))


# ---- palettes and composition

COLOURS = "pal AS (SELECT p_brand, p_type, n, row_number() OVER (ORDER BY n DESC, p_brand, p_type) - 1 AS color_id FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL))"


@query(f"WITH {COLOURS} SELECT p_brand, p_type, n, color_id FROM pal")
def palette_build(spark, d):
    return compose.palette(table(spark, d, "part"), ["p_brand", "p_type"])


@query(f"WITH {COLOURS} SELECT p_partkey, CASE WHEN color_id < 16 THEN color_id ELSE -1 END AS color_id FROM part JOIN pal USING (p_brand, p_type)")
def palette_apply(spark, d):
    part = table(spark, d, "part")
    few = compose.palette(part, ["p_brand", "p_type"]).filter("color_id < 16").select("p_brand", "p_type", "color_id")
    return part.join(F.broadcast(few), ["p_brand", "p_type"], "left").select("p_partkey", F.coalesce("color_id", F.lit(-1).cast("long")).alias("color_id"))


@query("""WITH m AS (SELECT unnest(['replace', 'add', 'mul', 'blend', 'alpha_add', 'none']) AS mode), s AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS top, (p_partkey % 97) / 97.0::DOUBLE AS bottom, (p_partkey % 11) / 10.0::DOUBLE AS fa, (p_partkey % 7) / 6.0::DOUBLE AS ba FROM part)
SELECT p_partkey, mode, round(CASE mode WHEN 'replace' THEN top WHEN 'add' THEN bottom + top WHEN 'mul' THEN bottom * top WHEN 'blend' THEN CASE WHEN 1 - (1 - fa) * (1 - ba) <= 0 THEN 0 ELSE (top * fa + bottom * ba * (1 - fa)) / (1 - (1 - fa) * (1 - ba)) END WHEN 'alpha_add' THEN bottom + top * fa ELSE bottom END, 6) AS v FROM s, m""")
def blend_modes(spark, d):
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ("replace", "add", "mul", "blend", "alpha_add", "none")))).alias("mode"), (F.col("p_size") / 50.0).alias("top"), ((key % 97) / 97.0).alias("bottom"), ((key % 11) / 10.0).alias("fa"), ((key % 7) / 6.0).alias("ba"))
    return rows.select("p_partkey", "mode", F.round(compose.blend(F.col("mode"), F.col("bottom"), F.col("top"), F.col("ba"), F.col("fa")), 6).alias("v"))


FRAMES = "fr AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'replace' ELSE 'add' END AS mode, CAST(round(value * 1000) AS BIGINT) AS v FROM events)"


@query(f"WITH {FRAMES}, g AS (SELECT *, sum(CASE WHEN mode = 'replace' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM fr) SELECT user_id, event_id, CAST(sum(v) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS BIGINT) AS canvas FROM g")
def compose_frames(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("first"))
    rows = e.crossJoin(F.broadcast(least)).select("user_id", "ts", "event_id", F.when(F.col("event_type") == F.col("first"), "replace").otherwise("add").alias("mode"), F.round(F.col("value") * 1000).cast("long").alias("v"))
    return compose.canvas(rows, "user_id", ["ts", "event_id"], "mode", "v").drop("ts")


# ---- metrics and reports


@query(f"WITH {PAIRS}, s AS (SELECT codec, count(*) AS n, CAST(sum((a - b) * (a - b)) AS BIGINT) AS sse FROM pairs GROUP BY codec) SELECT codec, n, sse, CASE WHEN sse = 0 THEN 99.99 ELSE round(10 * log10(1e14::DOUBLE * n / sse), 4) END AS psnr FROM s")
def psnr_by_codec(spark, d):
    return metrics.psnr(pairs(spark, d), "codec", "a", "b", 1e7)


@query(f"WITH {PAIRS}, s AS (SELECT codec, abs(a - b) / 1000000.0::DOUBLE AS d FROM pairs) SELECT codec, round((pow(avg(pow(d, 3)), 1 / 3.0::DOUBLE) + pow(avg(pow(d, 6)), 1 / 6.0::DOUBLE) + pow(avg(pow(d, 12)), 1 / 12.0::DOUBLE)) / 3, 6) AS norm FROM s GROUP BY codec")
def p_norm_distance(spark, d):
    return metrics.p_norm(pairs(spark, d), "codec", F.abs(F.col("a") - F.col("b")) / 1000000.0)


@query(f"WITH {PAIRS}, s AS (SELECT codec, 1 - b / a::DOUBLE AS d FROM pairs WHERE a > 0) SELECT codec, round(avg(d), 6) AS mean, round(sqrt(sqrt(avg(pow(d, 4)))), 6) AS norm4 FROM s GROUP BY codec")
def ssim_pooling(spark, d):
    return metrics.pooled(pairs(spark, d).filter("a > 0"), "codec", 1 - F.col("b") / F.col("a").cast("double"))


REPORT = f"{PAIRS}, rw AS (SELECT codec, a AS pixels, b AS bytes, CAST(l_quantity AS BIGINT) * 1000 AS micros, l_quantity / 10.0 AS distance FROM pairs)"


@query(f"WITH {REPORT} SELECT codec, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) * 8 / sum(pixels), 6) AS bpp, round(sum(pixels) / sum(micros), 6) AS mps, round(sqrt(sum(distance * distance * pixels) / sum(pixels)), 6) AS rms FROM rw GROUP BY codec")
def bench_columns(spark, d):
    rows = pairs(spark, d).select("codec", F.col("a").alias("pixels"), F.col("b").alias("bytes"), (F.col("l_quantity").cast("long") * 1000).alias("micros"), (F.col("l_quantity") / 10.0).alias("distance"))
    return metrics.report(rows, "codec")


@query(f"WITH {PAIRS}, r AS (SELECT codec, a, row_number() OVER (PARTITION BY codec ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY codec) AS n FROM pairs) SELECT codec, max(a) FILTER (WHERE k = n // 2) AS p50, max(a) FILTER (WHERE k = 9 * n // 10) AS p90, max(a) FILTER (WHERE k = 99 * n // 100) AS p99 FROM r GROUP BY codec")
def percentiles_floor(spark, d):
    return metrics.floor_percentiles(pairs(spark, d), "codec", "a", [50, 90, 99])


@query(f"WITH {PAIRS} SELECT codec, count(*) FILTER (WHERE a - b > 0) AS n, round(pow(2, avg(log2(a - b)) FILTER (WHERE a - b > 0)), 4) AS geomean FROM pairs GROUP BY codec")
def positive_geometric_mean(spark, d):
    return metrics.geometric(pairs(spark, d).withColumn("g", F.col("a") - F.col("b")), "codec", "g")


SPEED = "ev AS (SELECT user_id, ts, event_id, 1 + abs(value) AS t FROM events)"


@query(f"WITH {SPEED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, max(n) AS n, round(exp(avg(ln(t)) FILTER (WHERE n = 1 OR k > 1)), 4) AS speed, min(t) AS low, max(t) AS high FROM r GROUP BY user_id")
def speed_summary(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (1 + F.abs("value")).alias("t"))
    return metrics.speeds(rows, "user_id", ["ts", "event_id"], "t")


@query(f"WITH {SPEED}, r AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ev) SELECT user_id, event_id, t, round(100 * (t - b) / b, 4) AS moved, coalesce(abs(100 * (t - b) / b) > 5, false) AS flagged FROM r")
def regression_gate(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (1 + F.abs("value")).alias("t"))
    return metrics.regressions(rows, "user_id", ["ts", "event_id"], "t").drop("ts")


@query("SELECT l_suppkey, count(*) AS n, round(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) / (sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) + count(*) * 0.0005::DOUBLE), 6) AS slope FROM lineitem GROUP BY l_suppkey")
def cfl_slope(spark, d):
    return metrics.cfl_slope(table(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"))


@query("SELECT round(100 * l_discount) AS channel, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_quantity) AS used FROM lineitem GROUP BY ALL")
def channel_range(spark, d):
    return table(spark, d, "lineitem").groupBy(F.round(F.col("l_discount") * 100).alias("channel")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_distinct("l_quantity").alias("used"))


# ---- verdicts

FINDING = """finding AS (SELECT doc_id, source, quality, toxic, CASE WHEN n_chars > 20000 THEN 'indeterminate' WHEN n_chars < 2 THEN 'corrupt' WHEN quality IS NULL THEN 'unsupported' WHEN toxic = 1 THEN 'corrupt' WHEN quality = 0 THEN 'indeterminate' ELSE 'valid' END AS verdict,
CASE WHEN n_chars > 20000 THEN 'size_limit' WHEN n_chars < 2 THEN 'truncated' WHEN quality IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'none' END AS code FROM documents LEFT JOIN labels USING (doc_id))"""


def finding(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [(F.col("n_chars") > 20000, verdicts.INDETERMINATE, "size_limit"), (F.col("n_chars") < 2, verdicts.CORRUPT, "truncated"), (F.col("quality").isNull(), verdicts.UNSUPPORTED, "no_label"), (F.col("toxic") == 1, verdicts.CORRUPT, "toxic"), (F.col("quality") == 0, verdicts.INDETERMINATE, "low_quality")]
    return verdicts.first_finding(joined, rules).select("doc_id", "source", "quality", "toxic", "verdict", "code")


@query(f"WITH {FINDING} SELECT doc_id, verdict, code FROM finding")
def verdict_rules(spark, d):
    return finding(spark, d).select("doc_id", "verdict", "code")


@query(f"WITH {FINDING} SELECT source, count(*) FILTER (WHERE verdict = 'valid') AS n_valid, count(*) FILTER (WHERE verdict = 'corrupt') AS n_corrupt, count(*) FILTER (WHERE verdict = 'unsupported') AS n_unsupported, count(*) FILTER (WHERE verdict = 'indeterminate') AS n_indeterminate, count(*) AS n FROM finding GROUP BY source")
def verdict_matrix(spark, d):
    return verdicts.matrix(finding(spark, d), "source", "verdict")


@query(f"WITH {FINDING} SELECT doc_id, source FROM finding f WHERE verdict = 'corrupt' AND EXISTS (SELECT 1 FROM finding g WHERE g.source = f.source AND g.verdict = 'valid')")
def discriminating_rejections(spark, d):
    f = finding(spark, d)
    return verdicts.discriminating(f.filter("verdict = 'corrupt'").select("doc_id", "source"), f.filter("verdict = 'valid'").select("source"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_cases(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT event_id, CASE WHEN s > 0 THEN 'operational_failure' WHEN e = 2 THEN 'resource_failure' WHEN v = 'valid' THEN CASE WHEN e = 0 THEN 'valid' ELSE 'operational_failure' END WHEN v IN ('corrupt', 'unsupported', 'indeterminate') THEN v ELSE 'operational_failure' END AS outcome
FROM (SELECT event_id, event_id % 3 AS e, event_id % 17 = 0 AS k, CASE WHEN event_id % 17 = 0 THEN 9 ELSE 0 END AS s, ['valid', 'corrupt', 'unsupported', 'indeterminate', 'other'][1 + event_id % 5] AS v FROM events)""")
def outcome_classes(spark, d):
    i = F.col("event_id")
    verdict = F.element_at(F.array(*map(F.lit, ("valid", "corrupt", "unsupported", "indeterminate", "other"))), (1 + i % 5).cast("int"))
    return table(spark, d, "events").select("event_id", verdicts.classify(i % 3, verdict, F.when(i % 17 == 0, 9).otherwise(0)).alias("outcome"))


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def duplicated_fields(spark, d):
    return verdicts.duplicated_fields(table(spark, d, "conversations"), "conv_id", "role")


MUTANT = "mu AS (SELECT p_partkey, p_name AS base, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 2) WHEN 2 THEN '#' || substr(p_name, 2) WHEN 3 THEN '###' || substr(p_name, 4) ELSE '#' || substr(p_name, 2, length(p_name) - 2) || '#' END AS mutant FROM part)"


@query(f"""WITH {MUTANT}, e AS (SELECT *, unnest(range(greatest(length(base), length(mutant)))) AS i FROM mu), q AS (SELECT p_partkey, i FROM e WHERE substr(base, i + 1, 1) IS DISTINCT FROM substr(mutant, i + 1, 1)),
g AS (SELECT p_partkey, count(*) AS n, min(i) AS a, max(i) AS z FROM q GROUP BY p_partkey)
SELECT p_partkey, coalesce(n, 0) AS n_diff, a AS first_diff, z AS last_diff, CASE WHEN n IS NULL THEN 'same' WHEN length(mutant) < length(base) AND starts_with(base, mutant) THEN 'truncate' WHEN n = 1 THEN 'flip' WHEN z - a + 1 = n THEN 'burst' ELSE 'scatter' END AS kind FROM mu LEFT JOIN g USING (p_partkey)""")
def mutation_shape(spark, d):
    name, key = F.col("p_name"), F.col("p_partkey")
    cut = F.substring(name, F.lit(1), F.length(name) - 2)
    rest = lambda k: F.substring(name, F.lit(k), F.length(name))
    mutant = F.when(key % 5 == 0, name).when(key % 5 == 1, cut).when(key % 5 == 2, F.concat(F.lit("#"), rest(2))).when(key % 5 == 3, F.concat(F.lit("###"), rest(4))).otherwise(F.concat(F.lit("#"), F.substring(name, F.lit(2), F.length(name) - 2), F.lit("#")))
    found = verdicts.mutation(table(spark, d, "part").select("p_partkey", name.alias("base"), mutant.alias("mutant")), "base", "mutant")
    return found.select("p_partkey", "n_diff", "first_diff", "last_diff", "kind")


TREE = "if x > 31 if v > 40 - gradient 3 - left 0 if y > 5 if v > -100 - top 1 - zero 0 - select -2"


@query(f"WITH {PLANE} SELECT img, y, x, CASE WHEN x > 31 THEN CASE WHEN v > 40 THEN 'gradient' ELSE 'left' END WHEN y > 5 THEN CASE WHEN v > -100 THEN 'top' ELSE 'zero' END ELSE 'select' END AS predictor, CAST(CASE WHEN x > 31 THEN CASE WHEN v > 40 THEN 3 ELSE 0 END WHEN y > 5 THEN CASE WHEN v > -100 THEN 1 ELSE 0 END ELSE -2 END AS BIGINT) AS bias FROM plane")
def tree_case(spark, d):
    tree = trees.parse(TREE)
    assert not trees.check(tree)
    return plane(spark, d).select("img", "y", "x", trees.compile_case(tree, lambda n: F.lit(n.predictor)).alias("predictor"), trees.compile_case(tree, lambda n: F.lit(n.offset).cast("long")).alias("bias"))


# ---- sources, sinks, streams


@query("SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'codestream' WHEN 1 THEN 'container' WHEN 2 THEN 'not_enough_bytes' ELSE 'invalid' END AS kind FROM documents")
def signature_sniff(spark, d):
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit(containers.CODESTREAM), F.encode("text", "UTF-8"))).when(k == 1, containers.wrap(F.encode("text", "UTF-8"))).when(k == 2, F.lit(containers.SIGNATURE[:7])).otherwise(F.encode(F.concat(F.lit("x"), "text"), "UTF-8"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), containers.sniff(content).alias("kind"))


BOX_SQL = "b AS (SELECT doc_id, strlen(text) AS n FROM documents)"


@query(f"WITH {BOX_SQL} SELECT doc_id AS file_id, 0 AS ordinal, 'JXL ' AS type, 12 AS raw_size FROM b UNION ALL SELECT doc_id, 1, 'ftyp', 20 FROM b UNION ALL SELECT doc_id, 2, 'jxlc', n + 8 FROM b")
def box_scan(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), containers.wrap(F.encode("text", "UTF-8")).alias("content"))
    return containers.scan_boxes(files).select("file_id", "ordinal", "type", "raw_size")


@query("SELECT doc_id AS file_id, 1 AS fragments, sha256(text) AS digest FROM documents")
def codestream_assembly(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), containers.wrap(F.encode("text", "UTF-8")).alias("content"))
    return containers.codestreams(containers.scan_boxes(files)).select("file_id", "fragments", F.sha2("codestream", 256).alias("digest"))


@query(f"WITH {PLANE} SELECT img AS file_id, y, x, CAST(0 AS BIGINT) AS ch, ((v % 256) + 256) % 256 AS v FROM plane")
def raster_file_round_trip(spark, d):
    bytes_ = plane(spark, d).withColumn("v", F.pmod("v", F.lit(256)))
    return containers.samples(containers.write_pgm(bytes_))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("j")).select("event_id", "j.k")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_frame_counts(spark, d):
    return frames.run_once(spark, d, "events.parquet")

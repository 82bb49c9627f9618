"""Queries of filters, blurs, scores, matches and alias tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.functions.colour import ABSORBANCE, BIAS
from prismal.operators import alias, blur, matches, planes, scores, smoothing, splines
from prismal.plans.catalog import HIST, PLANE, plane, query, table
from prismal.plans.searches import source_histograms
from prismal.streaming import sessions

# ---- planes of three channels: the plane itself, and turned by a third and two thirds of its width

TURNS = (0, 21, 42)
CHANNELS = "channels AS (SELECT a.img, a.y, a.x, a.v / 1000.0::DOUBLE AS v0, b.v / 1000.0::DOUBLE AS v1, c.v / 1000.0::DOUBLE AS v2 FROM plane a JOIN plane b ON a.img = b.img AND a.y = b.y AND b.x = (a.x + 21) % 64 JOIN plane c ON a.img = c.img AND a.y = c.y AND c.x = (a.x + 42) % 64)"


def channels(spark: SparkSession, d: str) -> DataFrame:
    """All channels of a sample are in the array of its line, so nothing is dealt but the lines."""
    each = planes.lines(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("img", "y", "s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    at = [F.pmod(F.col("x") + t, F.lit(64)) for t in TURNS]
    values = [(F.round(F.get("s", k).cast("double") * 1000).cast("long") / 1000.0).alias(f"v{c}") for c, k in enumerate(at)]
    return each.filter(F.least(*at) < F.size("s")).select("img", "y", F.col("x").cast("long").alias("x"), *values)


# ---- blur

BLUR = 2.0


def _blur_sql(source: str, value: str, group: str, order: str, taps: list[float]) -> str:
    half = len(taps) // 2
    shifted = [f"{w!r}::DOUBLE * coalesce({'lag' if k < half else 'lead'}({value}, {abs(k - half)}) OVER w, 0)" if k != half else f"{w!r}::DOUBLE * {value}" for k, w in enumerate(taps)]
    return f"SELECT * EXCLUDE ({value}), {' + '.join(shifted)} AS {value} FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY {order})"


_TAPS = blur.kernel(BLUR)


@query(f"WITH {PLANE}, p AS (SELECT img, y, x, CAST(v AS DOUBLE) AS v FROM plane), h AS ({_blur_sql('p', 'v', 'img, y', 'x', _TAPS)}), b AS ({_blur_sql('h', 'v', 'img, x', 'y', _TAPS)}) SELECT img, y, x, round(v, 4) + 0.0 AS v FROM b")
def recursive_blur(spark, d):
    return blur.plane(plane(spark, d), BLUR, 32).withColumn("v", F.round("v", 4) + 0.0)


# ---- edge-preserving filter


def _epf_sql() -> str:
    """Three passes; each looks up the samples at most three steps away, mirrored at the borders."""
    out = [PLANE, CHANNELS, "size AS (SELECT img, max(y) + 1 AS h FROM plane GROUP BY img)", "e9 AS MATERIALIZED (SELECT *, -0.02::DOUBLE * (1 + (y // 8 + x // 8) % 5) - CASE WHEN (y // 8 + x // 8) % 7 = 6 THEN 5 ELSE 0 END AS sigma FROM channels JOIN size USING (img))"]
    steps = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if abs(dy) + abs(dx) <= 3]
    name = lambda c, dy, dx: f"n{c}_{dy + 3}_{dx + 3}"
    prior = "e9"
    for stage in (0, 1, 2):
        mirror = lambda c, n: f"CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} >= {n} THEN 2 * {n} - 1 - {c} ELSE {c} END"
        listed = ", ".join(f"({dy}, {dx})" for dy, dx in steps)
        out.append(f"k{stage} AS (SELECT e.img, e.y, e.x, dy, dx, {mirror('(e.y + dy)', 'h')} AS my, {mirror('(e.x + dx)', '64')} AS mx FROM {prior} e, (VALUES {listed}) s(dy, dx))")
        picks = ", ".join(f"max(p.v{c}) FILTER (dy = {dy} AND dx = {dx}) AS {name(c, dy, dx)}" for c in range(3) for dy, dx in steps)
        out.append(f"w{stage} AS (SELECT k.img, k.y, k.x, {picks} FROM k{stage} k JOIN {prior} p ON p.img = k.img AND p.y = my AND p.x = mx GROUP BY k.img, k.y, k.x)")
        offsets, patch = smoothing.WIDE if stage == 0 else smoothing.ADJACENT, smoothing.PLUS[:1] if stage == 2 else smoothing.PLUS
        factor = f"sigma * {1.65 * smoothing.PASS_SCALE[stage]!r}::DOUBLE * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN {smoothing.BORDER!r}::DOUBLE ELSE 1 END"
        weights = []
        for k, (dy, dx) in enumerate(offsets):
            apart = " + ".join(f"{smoothing.CHANNEL_SCALE[c]}::DOUBLE * ({' + '.join(f'abs({name(c, py, px)} - {name(c, py + dy, px + dx)})' for py, px in patch)})" for c in range(3))
            weights.append(f"greatest(1 + ({apart}) * f, 0) AS g{k}")
        out.append(f"g{stage}_ AS (SELECT *, {', '.join(weights)} FROM (SELECT *, {factor} AS f FROM w{stage} JOIN (SELECT img, y, x, h, sigma FROM {prior}) USING (img, y, x)))")
        total = "1 + " + " + ".join(f"g{k}" for k in range(len(offsets)))
        values = ", ".join(f"CASE WHEN sigma < {smoothing.LEAST_SIGMA!r}::DOUBLE THEN {name(c, 0, 0)} ELSE ({name(c, 0, 0)} + {' + '.join(f'g{k} * {name(c, dy, dx)}' for k, (dy, dx) in enumerate(offsets))}) / ({total}) END AS v{c}" for c in range(3))
        out.append(f"e{stage} AS MATERIALIZED (SELECT img, y, x, h, sigma, {values} FROM g{stage}_)")
        prior = f"e{stage}"
    return f"WITH {', '.join(out)} SELECT img, y, x, round(v0, 6) + 0.0 AS v0, round(v1, 6) + 0.0 AS v1, round(v2, 6) + 0.0 AS v2 FROM {prior}"


@query(_epf_sql())
def edge_preserving(spark, d):
    block = F.floor(F.col("y") / 8) + F.floor(F.col("x") / 8)
    sigma = -0.02 * (1 + block % 5) - F.when(block % 7 == 6, 5).otherwise(0)
    found = smoothing.edge_preserving(channels(spark, d).withColumn("sigma", sigma), tile=16)
    return found.select("img", "y", "x", *((F.round(c, 6) + 0.0).alias(c) for c in ("v0", "v1", "v2")))


# ---- the score of two pictures


def _score_sql() -> str:
    low = f"pow({BIAS!r}::DOUBLE, 1 / 3.0::DOUBLE)"
    cone = lambda k, s: f"(cbrt(greatest({' + '.join(f'{w!r}::DOUBLE * {c}{s}' for w, c in zip(ABSORBANCE[k], 'rgb', strict=True))} + {BIAS!r}::DOUBLE, 0)) - {low})"
    unit = lambda v: f"least(greatest({v} + 0.5::DOUBLE, 0), 1)"
    dull = lambda v: f"least(greatest(floor({v} * 16 + 0.5) / 16.0::DOUBLE + 0.5::DOUBLE, 0), 1)"
    taps = blur.kernel(scores.SIGMA)
    out = [PLANE, CHANNELS, f"q0 AS MATERIALIZED (SELECT img, y, x, 64 AS w, h, {', '.join(f'{unit(f'v{k}')} AS {c}1, {dull(f'v{k}')} AS {c}2' for k, c in enumerate('rgb'))} FROM channels JOIN (SELECT img, max(y) + 1 AS h FROM plane GROUP BY img) USING (img) WHERE h >= 8)"]
    for k in range(scores.SCALES):
        if k:
            share = "CASE WHEN x = w - 1 AND x % 2 = 0 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND y % 2 = 0 THEN 2 ELSE 1 END / 4.0::DOUBLE"
            out.append(f"q{k} AS MATERIALIZED (SELECT img, y // 2 AS y, x // 2 AS x, (max(w) + 1) // 2 AS w, (max(h) + 1) // 2 AS h, {', '.join(f'sum({c} * {share}) AS {c}' for c in ('r1', 'g1', 'b1', 'r2', 'g2', 'b2'))} FROM q{k - 1} WHERE w >= 8 AND h >= 8 GROUP BY img, y // 2, x // 2)")
        sides = ", ".join(f"{cone(i, s)} AS {n}{s}" for s in "12" for i, n in enumerate("lms"))
        chans = lambda s: (f"(l{s} - m{s}) * 0.5::DOUBLE * 14 + 0.42::DOUBLE", f"(l{s} + m{s}) * 0.5::DOUBLE + 0.01::DOUBLE", f"s{s} - (l{s} + m{s}) * 0.5::DOUBLE + 0.55::DOUBLE")
        out.append(f"l{k} AS (SELECT img, y, x, {sides} FROM q{k})")
        out.append(f"c{k} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT img, {c} AS c, y, x, {chans('1')[c]} AS a, {chans('2')[c]} AS b FROM l{k}" for c in range(3)) + ")")
        out.append(f"p{k} AS (SELECT *, a AS m1, b AS m2, a * a AS aa, b * b AS bb, a * b AS ab FROM c{k})")
        prior = f"p{k}"
        for direction, (group, order) in (("h", ("img, c, y", "x")), ("v", ("img, c, x", "y"))):
            for column in ("m1", "m2", "aa", "bb", "ab"):
                out.append(f"{direction}{k}{column} AS ({_blur_sql(prior, column, group, order, taps)})")
                prior = f"{direction}{k}{column}"
        out.append(f"d{k} AS (SELECT img, c, greatest(1 - (1 - (m1 - m2) * (m1 - m2)) * (2 * (ab - m1 * m2) + {scores.C2}::DOUBLE) / (aa - m1 * m1 + bb - m2 * m2 + {scores.C2}::DOUBLE), 0) AS st, (1 + abs(b - m2)) / (1 + abs(a - m1)) - 1 AS e FROM {prior})")
        out.append(f"e{k} AS (SELECT img, c, {k} AS scale, [avg(st), avg(greatest(e, 0)), avg(greatest(-e, 0)), pow(avg(pow(st, 4)), 0.25), pow(avg(pow(greatest(e, 0), 4)), 0.25), pow(avg(pow(greatest(-e, 0), 4)), 0.25)] AS m FROM d{k} GROUP BY img, c)")
    first, p, q, r, times, power = scores.CURVE
    out.append("t AS (SELECT *, max(scale) OVER (PARTITION BY img) + 1 AS scales FROM (" + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(scores.SCALES)) + "))")
    out.append(f"u AS (SELECT img, scales, sum(abs(m[j + 1]) * [{', '.join(f'{w!r}::DOUBLE' for w in scores.WEIGHTS)}][(c * scales + scale) * 6 + j + 1]) AS error FROM t, (SELECT unnest(range(6)) AS j) GROUP BY img, scales)")
    return f"WITH {', '.join(out)} SELECT img, CAST(scales AS BIGINT) AS scales, round(error, 5) AS error, round(CASE WHEN k > 0 THEN 100 - {times} * pow(k, {power}) ELSE 100 END, 5) AS score FROM (SELECT *, {p} * z + {q} * z * z + {r} * z * z * z AS k FROM (SELECT *, error * {first} AS z FROM u))"


@query(_score_sql())
def picture_scores(spark, d):
    unit = lambda v: F.least(F.greatest(v + 0.5, F.lit(0.0)), F.lit(1.0))
    dull = lambda v: unit(F.floor(v * 16 + 0.5) / 16.0)
    pairs = channels(spark, d).select("img", "y", "x", *(unit(F.col(f"v{k}")).alias(f"{c}1") for k, c in enumerate("rgb")), *(dull(F.col(f"v{k}")).alias(f"{c}2") for k, c in enumerate("rgb")))
    return scores.score(pairs).select("img", "scales", F.round("error", 5).alias("error"), F.round("score", 5).alias("score"))


# ---- matches


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def lz77_round_trip(spark, d):
    docs = table(spark, d, "documents")
    back = matches.texts(matches.tokens(docs, "doc_id", "text"), together=True).withColumnRenamed("key", "doc_id")
    empty = docs.filter(F.coalesce("text", F.lit("")) == "").select("doc_id", F.lit("").alias("text"))  # no tokens
    return back.union(empty).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


# ---- alias tables

_HELD = HIST.replace("lang AS ctx", "source || ':' || lang AS ctx")
_DIST = f"""{_HELD}, sc AS (SELECT ctx, sym, n, greatest(n * 4096 // t, 1) AS f, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, sym) AS o FROM hist JOIN tot USING (ctx)),
ds AS MATERIALIZED (SELECT ctx, list(CAST(f + CASE WHEN o = 1 THEN rest ELSE 0 END AS BIGINT) ORDER BY sym) AS dist FROM (SELECT *, 4096 - sum(f) OVER (PARTITION BY ctx) AS rest FROM sc) GROUP BY ctx)"""
_ALIAS = f"""WITH RECURSIVE {_DIST},
st AS (SELECT ctx, 0 AS k, list_transform(range(256), lambda i: coalesce(dist[i + 1], 0)) AS cut, list_filter(range(256), lambda i: coalesce(dist[i + 1], 0) < 16) AS under, list_filter(range(256), lambda i: coalesce(dist[i + 1], 0) > 16) AS over_, list_transform(range(256), lambda i: 0::BIGINT) AS right_, list_transform(range(256), lambda i: 0::BIGINT) AS off FROM ds WHERE len(dist) <= 256
UNION ALL SELECT ctx, k + 1, list_transform(cut, lambda c, i: CASE WHEN i - 1 = g THEN l ELSE c END), list_concat(under[:-2], CASE WHEN l < 16 THEN [g] ELSE [] END), list_concat(over_[:-2], CASE WHEN l > 16 THEN [g] ELSE [] END),
 list_transform(right_, lambda c, i: CASE WHEN i - 1 = u THEN g ELSE c END), list_transform(off, lambda c, i: CASE WHEN i - 1 = u THEN l ELSE c END)
 FROM (SELECT *, cut[g + 1] - (16 - cut[u + 1]) AS l FROM (SELECT *, over_[-1] AS g, under[-1] AS u FROM st WHERE len(over_) > 0)))
SELECT s.ctx, i, CAST(CASE WHEN full_ THEN 0 ELSE cut[i + 1] END AS BIGINT) AS cutoff, r AS "right", CAST(CASE WHEN full_ THEN 0 ELSE off[i + 1] - cut[i + 1] END AS BIGINT) AS "offset", coalesce(dist[i + 1], 0) AS freq0, xor(coalesce(dist[i + 1], 0), coalesce(dist[r + 1], 0)) AS freq1_xor_freq0
FROM (SELECT *, cut[i + 1] = 16 AS full_, CASE WHEN cut[i + 1] = 16 THEN i ELSE right_[i + 1] END AS r FROM (SELECT *, unnest(range(256)) AS i FROM st WHERE len(over_) = 0)) s JOIN ds ON ds.ctx = s.ctx WHERE NOT list_contains(dist, 4096)"""


@query(_ALIAS)
def alias_tables(spark, d):
    found = alias.normalized(source_histograms(spark, d), "ctx").select("ctx", alias.table(F.col("dist")).alias("e"))
    return found.select("ctx", F.posexplode("e").alias("i", "e")).select("ctx", F.col("i").cast("long").alias("i"), "e.*")


@query(f"WITH {_DIST} SELECT ctx, CAST(i - 1 AS BIGINT) AS symbol, dist[i] AS n, dist[i] AS offsets, 0 AS least, dist[i] - 1 AS most, dist[i] AS freq FROM (SELECT *, unnest(range(1, len(dist) + 1)) AS i FROM ds WHERE len(dist) <= 256)")
def alias_lookups(spark, d):
    """Every value of the range through the table: each symbol gets as many as its count, at offsets from zero on."""
    found = alias.normalized(source_histograms(spark, d), "ctx").select("ctx", alias.table(F.col("dist")).alias("e")).filter("e is not null")
    each = found.select("ctx", "e", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("value"))
    got = each.select("ctx", alias.lookup(F.col("e"), F.col("value")).alias("g")).select("ctx", "g.*")
    return got.groupBy("ctx", "symbol").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("offsets"), F.min("offset").alias("least"), F.max("offset").alias("most"), F.max("freq").alias("freq"))


# ---- splines: a curve of six control points per embedding, its colours and width from further numbers

SIDE = 160


def control_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    at = lambda k: F.round(80 + 120 * F.col("embedding")[k].cast("double"))
    points = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), at(2 * k).alias("x"), at(2 * k + 1).alias("y")) for k in range(6)))
    return e.select(F.col("vec_id").alias("curve"), F.explode(points).alias("p")).select("curve", "p.*")


def strokes(spark: SparkSession, d: str) -> DataFrame:
    term = lambda k: F.round(F.col("embedding")[k].cast("double"), 3)
    colors = (F.array(*(term(12 + 4 * c + k) for k in range(4))).alias(f"color{c}") for c in range(3))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("curve"), *colors, F.array(F.abs(term(30)) * 2 + 0.5, term(31) / 4).alias("sigma"))


def _marks_sql() -> str:
    lerp = lambda a, b, ta, tb: f"({a} + ({b} - {a}) * ((t - {ta}) / ({tb} - {ta})))"

    def at(c: str) -> str:
        a1, a2, a3 = lerp(f"{c}0", f"{c}1", "0", "t1"), lerp(f"{c}1", f"{c}2", "t1", "t2"), lerp(f"{c}2", f"{c}3", "t2", "t3")
        return lerp(lerp(a1, a2, "0", "t2"), lerp(a2, a3, "t1", "t3"), "t1", "t2")

    far = lambda k: f"pow(pow(x{k + 1} - x{k}, 2) + pow(y{k + 1} - y{k}, 2), 0.25::DOUBLE)"
    near = ", ".join(f"coalesce(lag({c}) OVER w, 2 * {c} - lead({c}) OVER w) AS {c}0, {c} AS {c}1, lead({c}) OVER w AS {c}2, coalesce(lead({c}, 2) OVER w, 2 * lead({c}) OVER w - {c}) AS {c}3" for c in "xy")
    return f"""raw AS (SELECT vec_id AS curve, k, round(80 + 120 * CAST(embedding[2 * k + 1] AS DOUBLE)) AS x, round(80 + 120 * CAST(embedding[2 * k + 2] AS DOUBLE)) AS y FROM embeddings, (SELECT unnest(range(6)) AS k)),
kept AS (SELECT curve, row_number() OVER (PARTITION BY curve ORDER BY k) - 1 AS k, x, y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM raw WINDOW w AS (PARTITION BY curve ORDER BY k)) WHERE px IS NULL OR px <> x OR py <> y),
sp AS (SELECT curve, k, {near} FROM kept WINDOW w AS (PARTITION BY curve ORDER BY k)),
sd AS (SELECT *, {far(0)} AS d0, {far(1)} AS d1, {far(2)} AS d2 FROM sp WHERE x2 IS NOT NULL),
sm AS (SELECT *, d0 AS t1, d0 + d1 AS t2, d0 + d1 + d2 AS t3, d0 + d1 * i / 16.0::DOUBLE AS t FROM sd, (SELECT unnest(range(16)) AS i)),
pts AS (SELECT curve, k * 16 + i AS place, CASE WHEN i = 0 THEN x1 ELSE {at('x')} END AS x, CASE WHEN i = 0 THEN y1 ELSE {at('y')} END AS y FROM sm
 UNION ALL SELECT curve, max(k) * 16, arg_max(x, k), arg_max(y, k) FROM kept GROUP BY curve HAVING count(*) > 1),
own AS (SELECT *, coalesce(sqrt(pow(bx - x, 2) + pow(by_ - y, 2)), 0) AS own FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM pts WINDOW w AS (PARTITION BY curve ORDER BY place))),
upto AS (SELECT *, sum(own) OVER (PARTITION BY curve ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(own) OVER (PARTITION BY curve) AS length FROM own),
marks AS MATERIALIZED (SELECT curve, mark, x + (bx - x) * s AS x, y + (by_ - y) * s AS y, 1.0::DOUBLE AS part, length FROM (SELECT *, CASE WHEN own > 0 THEN (mark - (upto - own)) / own ELSE 0 END AS s FROM (
  SELECT *, unnest(range(CASE WHEN place = 0 THEN 0 ELSE CAST(floor(upto - own) AS BIGINT) + 1 END, CAST(floor(upto) AS BIGINT) + 1)) AS mark FROM upto WHERE bx IS NOT NULL))
 UNION ALL SELECT curve, CAST(floor(length) AS BIGINT) + 1, x, y, length - floor(length), length FROM upto WHERE bx IS NULL AND length > floor(length))"""


@query(f"WITH {_marks_sql()} SELECT curve, mark, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(part, 3) AS part FROM marks")
def spline_marks(spark, d):
    found = splines.marks(control_points(spark, d))
    return found.select("curve", "mark", *((F.round(c, 3) + 0.0).alias(c) for c in ("x", "y", "part")))


def _canvas_sql() -> str:
    value = lambda terms: "sqrt(2.0::DOUBLE) * (" + " + ".join(f"({t}) * cos({k} * pi() / 32 * (t + 0.5))" for k, t in enumerate(terms)) + ")"
    term = lambda k: f"round(CAST(embedding[{k + 1}] AS DOUBLE), 3)"
    colors = ", ".join(f"{value([term(12 + 4 * c + k) for k in range(4)])} * part AS c{c}" for c in range(3))
    p = lambda x: " + ".join(f"{c!r}::DOUBLE * pow({x}, {k})" for k, c in enumerate(splines.ERF))
    erf = lambda x: f"(CASE WHEN {x} <= 0 THEN -1 ELSE 1 END * (1 - 1 / pow({p(f'abs({x})')}, 4)))"
    return f"""{_marks_sql()}, br AS (SELECT x, y, {value([f"abs({term(30)}) * 2 + 0.5", f"{term(31)} / 4"])} AS sigma, {colors} FROM (SELECT m.*, embedding, least(1, mark / greatest(length, 1e-12)) * 31 AS t FROM marks m JOIN embeddings e ON e.vec_id = m.curve)),
rc AS (SELECT *, sqrt(greatest(0, -2 * sigma * sigma * (3 * ln(0.1::DOUBLE) - ln(greatest(abs(c0), abs(c1), abs(c2), 0.01::DOUBLE))))) AS reach FROM br WHERE sigma <> 0),
ys AS (SELECT *, unnest(range(greatest(0, CAST(floor(y - reach + 0.5) AS BIGINT)), least({SIDE}, CAST(floor(y + reach + 0.5) AS BIGINT) + 1))) AS py FROM rc),
xs AS (SELECT *, unnest(range(greatest(0, CAST(floor(x - reach + 0.5) AS BIGINT)), least({SIDE}, CAST(floor(x + reach + 0.5) AS BIGINT) + 1))) AS px FROM ys),
ds AS (SELECT *, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS d FROM xs), fs AS (SELECT *, (0.5 * d + sqrt(0.125::DOUBLE)) / sigma AS u, (0.5 * d - sqrt(0.125::DOUBLE)) / sigma AS w FROM ds),
gs AS (SELECT *, pow({erf('u')} - {erf('w')}, 2) * 0.25 * sigma AS weight FROM fs)"""


@query(f"WITH {_canvas_sql()} SELECT py AS y, px AS x, round(sum(c0 * weight), 4) + 0.0 AS v0, round(sum(c1 * weight), 4) + 0.0 AS v1, round(sum(c2 * weight), 4) + 0.0 AS v2 FROM gs GROUP BY py, px HAVING abs(sum(c0 * weight)) + abs(sum(c1 * weight)) + abs(sum(c2 * weight)) > 0.001")
def spline_canvas(spark, d):
    brush = splines.brushes(splines.marks(control_points(spark, d)), strokes(spark, d))
    found = splines.canvas(brush, SIDE, SIDE)
    return found.filter(F.abs("v0") + F.abs("v1") + F.abs("v2") > 0.001).select("y", "x", *((F.round(c, 4) + 0.0).alias(c) for c in ("v0", "v1", "v2")))


# ---- sessions of frames in a stream

_FRAMES = """fr AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'add' WHEN 'signup' THEN 'keep' ELSE 'replace' END AS mode, k // 4 % 4 AS source, k % 4 AS save, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS duration, v,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events))"""


def session_frames(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    mode = F.when(F.col("event_type").isin("purchase", "click"), "add").when(F.col("event_type") == "signup", "keep").otherwise("replace")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), mode.alias("mode"), F.floor(k / 4 % 4).cast("int").alias("source"), (k % 4).alias("save"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("duration"), F.round(F.col("value") * 100).cast("long").alias("value"))


@query(f"""WITH RECURSIVE {_FRAMES}, r AS (SELECT DISTINCT user_id, 0 AS n, NULL::BIGINT AS event_id, [0, 0, 0, 0]::BIGINT[] AS slots, 0::BIGINT AS visible, 0::BIGINT AS hidden, 0::BIGINT AS canvas FROM fr
UNION ALL SELECT user_id, n, event_id, CASE WHEN duration = 0 OR save > 0 THEN list_transform(slots, lambda s, i: CASE WHEN i = save + 1 THEN canvas ELSE s END) ELSE slots END, CASE WHEN duration > 0 THEN visible + 1 ELSE visible END, CASE WHEN duration > 0 THEN 0 ELSE hidden + 1 END, canvas
 FROM (SELECT r.user_id, f.n, f.event_id, r.slots, r.visible, r.hidden, f.duration, f.save, CASE f.mode WHEN 'replace' THEN v WHEN 'add' THEN r.slots[f.source + 1] + v ELSE r.slots[f.source + 1] END AS canvas FROM r JOIN fr f ON f.user_id = r.user_id AND f.n = r.n + 1))
SELECT user_id AS session, event_id AS id, visible, hidden, canvas, '[' || array_to_string(slots, ', ') || ']' AS slots, false AS late FROM r WHERE n > 0""")
def stream_session_slots(spark, d):
    """The events arrive in files out of order; the rows are those of a batch in order."""
    files = spark.sparkContext.defaultParallelism
    folder = sessions.arrived(session_frames(spark, d), 5, files)
    return sessions.run(spark, folder, sessions.SCHEMA, "15 days", files).filter("session >= 0")

"""Queries that search: decision trees, clusters of histograms, the self-correcting predictor, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.functions import scalar as S
from prismal.operators import blobs, clusters, planes, symbols, tree_search, trees, weighted
from prismal.plans.catalog import HIST, NEAR, PLANE, plane, query, table

# ---- decision trees

PROPERTIES = {"img": "img", "x": "x", "t": "t", "l": "l", "level": "l + t - tl", "left_slope": "l - tl", "right_slope": "t - tr"}
RESIDUALS = {"zero": "0", "gradient": "CASE WHEN tl < least(l, t) THEN greatest(l, t) WHEN tl > greatest(l, t) THEN least(l, t) ELSE l + t - tl END", "left": "l"}
CHUNKS, THRESHOLD, LEVELS = 8, 20.0, 3


def tree_samples(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[int]]]:
    near = planes.neighbours(plane(spark, d))
    exact = near.select("*", *(F.expr(x).alias(p) for p, x in PROPERTIES.items() if p != x))
    tops = tree_search.chunk_tops(exact, list(PROPERTIES), CHUNKS)
    quantized = (tree_search.quantized(F.col(p), tops[p]).alias(p) for p in PROPERTIES)
    coded = {p: S.hybrid_uint(S.pack_signed(F.col("v") - planes.predictor(p))) for p in RESIDUALS}
    return exact.select("y", F.col("img").alias("plane"), F.col("x").alias("column"), *quantized, *(coded[p]["token"].alias(f"{p}_token") for p in RESIDUALS), *(coded[p]["n_bits"].alias(f"{p}_bits") for p in RESIDUALS)), tops


def _tree_ctes() -> str:
    """Samples, and for each level its counts, sides, best tests and nodes."""
    props, preds = list(PROPERTIES), list(RESIDUALS)
    fn = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END)"
    out = [PLANE, NEAR]
    token = "CASE WHEN u < 16 THEN u ELSE 16 + (k - 4) * 4 + ((u - (1 << k)) // (1 << (k - 2))) END"
    out.append("r0 AS (SELECT " + ", ".join(f"{x} AS p{i}" for i, x in enumerate(PROPERTIES.values())) + ", " + ", ".join(f"v - ({x}) AS e{i}" for i, x in enumerate(RESIDUALS.values())) + ", img, y, x FROM near)")
    for i in range(len(props)):
        out.append(f"c{i} AS (SELECT p{i} AS value, count(*) AS n FROM r0 GROUP BY p{i})")
        out.append(f"g{i} AS (SELECT value, floor(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {CHUNKS} / sum(n) OVER ()) AS part FROM c{i})")
        out.append(f"m{i} AS MATERIALIZED (SELECT value, max(value) OVER (PARTITION BY part) AS top FROM g{i})")
    for i in range(len(preds)):
        prior = "r0" if i == 0 else f"t{i - 1}"
        out.append(f"u{i} AS (SELECT *, CASE WHEN e{i} >= 0 THEN 2 * e{i} ELSE -2 * e{i} - 1 END AS u FROM {prior})")
        out.append(f"v{i} AS (SELECT *, length(bin(greatest(u, 1))) - 1 AS k FROM u{i})")
        out.append(f"t{i} AS (SELECT * EXCLUDE (u, k), {token} AS tok{i}, CASE WHEN u < 16 THEN 0 ELSE k - 2 END AS raw{i} FROM v{i})")
    out.append("s0 AS MATERIALIZED (SELECT img, y, x, 1 AS node, " + ", ".join(f"m{i}.top AS q{i}" for i in range(len(props))) + ", " + ", ".join(f"tok{i}, raw{i}" for i in range(len(preds))) + f" FROM t{len(preds) - 1}" + "".join(f" JOIN m{i} ON m{i}.value = p{i}" for i in range(len(props))) + ")")
    out.append("z0 AS (SELECT 1 AS node, 0 AS predictor)")
    for lv in range(LEVELS):
        long = " UNION ALL ".join(f"SELECT node, {p} AS prop, q{p} AS value, {q} AS pred, tok{q} AS token, count(*) AS n, sum(raw{q}) AS raw FROM s{lv} GROUP BY ALL" for p in range(len(props)) for q in range(len(preds)))
        w = "PARTITION BY node, prop, pred"
        rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        out.append(f"a{lv} AS (SELECT *, sum(n) OVER ({w}, token ORDER BY value {rows}) AS upto, sum(n) OVER ({w}, token) AS every FROM ({long}))")
        out.append(f"b{lv} AS (SELECT node, prop, pred, value, sum(n) AS n, sum(raw) AS raw, sum({fn('upto')} - {fn('(upto - n)')}) AS below, sum({fn('(every - upto)')} - {fn('(every - upto + n)')}) AS above FROM a{lv} GROUP BY ALL)")
        out.append(f"d{lv} AS (SELECT node, prop, pred, value, sum(n) OVER r AS n, sum(raw) OVER r AS raw, sum(below) OVER r AS below, sum(above) OVER r AS above, sum(n) OVER a AS all_n, sum(raw) OVER a AS all_raw, sum(below) OVER a AS all_f FROM b{lv} WINDOW r AS ({w} ORDER BY value {rows}), a AS ({w}))")
        out.append(f"e{lv} AS (SELECT d.*, predictor, {fn('n')} - below + raw AS other, {fn('(all_n - n)')} - (all_f + above) + all_raw - raw AS more, {fn('all_n')} - all_f + all_raw AS base FROM d{lv} d JOIN z{lv} USING (node))")
        penalty = f"CASE WHEN pred <> predictor THEN {tree_search.PENALTY / (100 + THRESHOLD)} ELSE 0 END"
        out.append(f"h{lv} AS (SELECT node, prop, value, min(struct_pack(k := round(other + {penalty}, 6), p := pred, c := other)) AS o, min(struct_pack(k := round(more + {penalty}, 6), p := pred, c := more)) AS m FROM e{lv} WHERE n < all_n GROUP BY ALL)")
        out.append(f"i{lv} AS (SELECT node, min(struct_pack(c := round(o.c + m.c, 6), prop := prop, value := value, m := m.p, o := o.p)) AS b FROM h{lv} GROUP BY node)")
        out.append(f"j{lv} AS MATERIALIZED (SELECT node, b.prop AS prop, b.value AS value, b.m AS m, b.o AS o, bits, b.c AS cost FROM i{lv} JOIN (SELECT node, max(base) AS bits FROM e{lv} WHERE prop = 0 AND pred = predictor GROUP BY node) USING (node) WHERE b.c + {THRESHOLD} < bits)")
        out.append(f"z{lv + 1} AS (SELECT 2 * node AS node, m AS predictor FROM j{lv} UNION ALL SELECT 2 * node + 1, o FROM j{lv})")
        pick = "CASE j.prop " + " ".join(f"WHEN {i} THEN q{i}" for i in range(len(props))) + " END"
        out.append(f"s{lv + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (node), 2 * s.node + CASE WHEN {pick} > j.value THEN 0 ELSE 1 END AS node FROM s{lv} s JOIN j{lv} j ON s.node = j.node)")
    return ", ".join(out)


_NAMES = ["['" + "', '".join(x) + "']" for x in (PROPERTIES, RESIDUALS)]
_NODES = " UNION ALL ".join(f"SELECT * FROM z{k}" for k in range(LEVELS + 1))
_TESTS = " UNION ALL ".join(f"SELECT node, prop, value, bits, cost FROM j{k}" for k in range(LEVELS))


@query(f"WITH {_tree_ctes()} SELECT n.node, {_NAMES[1]}[predictor + 1] AS predictor, {_NAMES[0]}[prop + 1] AS prop, value, round(bits, 3) AS bits, round(cost, 3) AS cost FROM ({_NODES}) n LEFT JOIN ({_TESTS}) t USING (node)")
def tree_splits(spark, d):
    found = tree_search.search(tree_samples(spark, d)[0], list(PROPERTIES), list(RESIDUALS), THRESHOLD, LEVELS)
    return found.select("node", "predictor", "prop", "value", F.round("bits", 3).alias("bits"), F.round("cost", 3).alias("cost"))


_LEAF = " UNION ALL ".join(f"SELECT s.img, s.y, s.x, n.predictor FROM s{k} s JOIN z{k} n USING (node)" + (f" WHERE node NOT IN (SELECT node FROM j{k})" if k < LEVELS else "") for k in range(LEVELS + 1))


@query(f"WITH {_tree_ctes()} SELECT img, {_NAMES[1]}[predictor + 1] AS predictor, count(*) AS n, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM ({_LEAF}) GROUP BY ALL")
def tree_learned(spark, d):
    """The tree that was found, compiled over the samples: how many of each plane each predictor gets."""
    samples = tree_samples(spark, d)[0]
    tree = tree_search.tree_of(tree_search.search(samples, list(PROPERTIES), list(RESIDUALS), THRESHOLD, LEVELS))
    assert not trees.check(tree)
    placed = samples.select(F.col("plane").alias("img"), "y", F.col("column").alias("x"), trees.compile_case(tree, lambda n: F.lit(n.predictor)).alias("predictor"))
    return placed.groupBy("img", "predictor").agg(F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("places"))


# ---- clusters of histograms


def source_histograms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("ctx", F.concat_ws(":", "source", "lang"))
    return symbols.text_histogram(docs, "ctx", "text")


def _f(n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {n} * log2({n}) ELSE 0 END)"


def _distance(name: str, centre: str) -> str:
    """ctx and its distance to the centre (a relation of one ctx)."""
    return f"""{name} AS MATERIALIZED (SELECT t.ctx, round({_f('(t.t + u.t)')} - {_f('t.t')} - {_f('u.t')} - coalesce(s, 0), 6) AS d FROM tot t JOIN {centre} c ON true JOIN tot u ON u.ctx = c.ctx
  LEFT JOIN (SELECT a.ctx, sum({_f('(a.n + b.n)')} - {_f('a.n')} - {_f('b.n')}) AS s FROM hist a JOIN hist b USING (sym) JOIN {centre} c ON b.ctx = c.ctx GROUP BY a.ctx) x ON x.ctx = t.ctx)"""


def _fast_ctes(k: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT ctx FROM tot ORDER BY t DESC, ctx LIMIT 1)"]
    for i in range(k):
        out.append(_distance(f"d{i}", f"c{i}"))
        if i + 1 < k:
            least = "least(" + ", ".join(f"d{j}.d" for j in range(i + 1)) + ")" if i else "d0.d"
            chosen = " OR ".join(f"d0.ctx IN (SELECT ctx FROM c{j})" for j in range(i + 1))
            joins = " ".join(f"JOIN d{j} ON d0.ctx = d{j}.ctx" for j in range(1, i + 1))
            out.append(f"f{i} AS (SELECT d0.ctx, CASE WHEN {chosen} THEN 0 ELSE {least} END AS d FROM d0 {joins})")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT ctx FROM (SELECT * FROM f{i} ORDER BY d DESC, ctx LIMIT 1) WHERE d >= {clusters.DISTINCT} AND d > 0)")
    near = " UNION ALL ".join(f"SELECT ctx, CASE WHEN ctx IN (SELECT ctx FROM c{i}) THEN -1 ELSE d END AS d, {i} AS c FROM d{i}" for i in range(k))
    out.append(f"assigned AS MATERIALIZED (SELECT ctx, CAST(min(struct_pack(d := d, c := c)).c AS BIGINT) AS cluster FROM ({near}) GROUP BY ctx)")
    return ", ".join(out)


@query(f"WITH {HIST}, {_fast_ctes(2)} SELECT ctx, cluster FROM assigned")
def histogram_clusters(spark, d):
    return clusters.fast(symbols.text_histogram(table(spark, d, "documents"), "lang", "text"), 2)


K, ROUNDS = 6, 5
_HELD = HIST.replace("lang AS ctx", "source || ':' || lang AS ctx")


def _best_ctes() -> str:
    out = [_HELD, _fast_ctes(K), "a0 AS (SELECT * FROM assigned)", "h0 AS MATERIALIZED (SELECT cluster, sym, sum(n) AS n FROM hist JOIN assigned USING (ctx) GROUP BY ALL)"]
    cost = f"round(sum(n * log2(t / n) + 5 + floor(log2(greatest(floor(n * {1 << clusters.TABLE_BITS} / t), 1)))), 6)"
    for r in range(ROUNDS):
        out.append(f"k{r} AS MATERIALIZED (SELECT cluster, {cost} AS cost FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS t FROM h{r}) GROUP BY cluster)")
        out.append(f"p{r} AS (SELECT a.cluster AS a, b.cluster AS b, a.cost AS ca, b.cost AS cb FROM k{r} a JOIN k{r} b ON a.cluster < b.cluster)")
        out.append(f"q{r} AS (SELECT a, b, ca, cb, sym, sum(n) AS n FROM p{r} JOIN h{r} ON cluster = a OR cluster = b GROUP BY ALL)")
        out.append(f"g{r} AS MATERIALIZED (SELECT a, b, gain FROM (SELECT a, b, round({cost} - ca - cb, 6) AS gain FROM (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t FROM q{r}) GROUP BY a, b, ca, cb) WHERE gain < 0)")
        out.append(f"m{r} AS MATERIALIZED (SELECT m.a AS a, m.b AS b FROM (SELECT e, min(struct_pack(gain := gain, a := a, b := b)) AS m FROM (SELECT *, unnest([a, b]) AS e FROM g{r}) GROUP BY e) GROUP BY m.a, m.b HAVING count(*) = 2)")
        out.append(f"a{r + 1} AS MATERIALIZED (SELECT ctx, coalesce(m.a, cluster) AS cluster FROM a{r} LEFT JOIN m{r} m ON m.b = cluster)")
        out.append(f"h{r + 1} AS MATERIALIZED (SELECT coalesce(m.a, cluster) AS cluster, sym, sum(n) AS n FROM h{r} LEFT JOIN m{r} m ON m.b = cluster GROUP BY ALL)")
    return ", ".join(out)


@query(f"WITH {_best_ctes()} SELECT ctx, cluster FROM a{ROUNDS}")
def histogram_clusters_best(spark, d):
    return clusters.best(source_histograms(spark, d), K)


@query(f"WITH {HIST} SELECT ctx, round(sum(n * log2(t / n) + 5 + floor(log2(greatest(floor(n * 4096 / t), 1)))), 3) AS cost FROM hist JOIN tot USING (ctx) GROUP BY ctx")
def population_cost(spark, d):
    return clusters.population_cost(symbols.histogram(symbols.of_text(table(spark, d, "documents"), "doc_id", "lang", "text")), "ctx").withColumn("cost", F.round("cost", 3))


# ---- the self-correcting predictor

GROUP = 16


def _weighted_sql() -> str:
    """Sample after sample of every group; p and c hold the errors of the row above and of this row so far: [error, four sizes]."""
    zero = "[0, 0, 0, 0, 0]::BIGINT[]"
    w1, w2, w3, w4 = weighted.WEIGHTS
    shifted = lambda i: f"greatest(length(bin(s{i} + 1)) - 6, 0)"
    weight = lambda i, m: f"4 + (({m} * (16777216 // ((s{i} >> {shifted(i)}) + 1))) >> {shifted(i)})"
    size = lambda i: f"((abs(sub{i} - val) + 3) >> 3)"
    sums = lambda i: f"(pn[{i}] + cw[{i}]) + CASE WHEN x = 0 THEN pn[{i}] + cw[{i}] ELSE pw[{i}] + cww[{i}] END + CASE WHEN x = w - 1 THEN pn[{i}] + cw[{i}] ELSE pe[{i}] END"
    return f"""WITH RECURSIVE {PLANE}, grouped AS (SELECT *, y // {GROUP} AS ty, x // {GROUP} AS tx FROM plane), {NEAR.replace("FROM plane WINDOW", "FROM grouped WINDOW").replace("PARTITION BY img, x ", "PARTITION BY img, ty, tx, x ").replace("PARTITION BY img, y ", "PARTITION BY img, ty, tx, y ").replace("SELECT img, y, x, v, coalesce", "SELECT ty, tx, img, y, x, v, coalesce")},
cells AS (SELECT *, max(x) OVER (PARTITION BY img, ty, tx) - tx * {GROUP} + 1 AS w FROM near),
held AS MATERIALIZED (SELECT img, ty, tx, w, list(struct_pack(v := v, l := l, t := t, tl := tl, tr := tr, tt := tt) ORDER BY y, x) AS cells FROM cells GROUP BY ALL),
run AS (SELECT img, ty, tx, 0 AS k, list_transform(range(w), lambda z: {zero}) AS p, []::BIGINT[][] AS c, NULL::BIGINT AS prediction, NULL::BIGINT AS error FROM held
UNION ALL
SELECT img, ty, tx, k + 1, CASE WHEN x = w - 1 THEN list_append(c, new) ELSE p END, CASE WHEN x = w - 1 THEN []::BIGINT[][] ELSE list_append(c, new) END, (mean + 3) >> 3, most FROM (
 SELECT *, [mean - val, {", ".join(size(i) for i in (1, 2, 3, 4))}]::BIGINT[] AS new FROM (
 SELECT *, CASE WHEN (xor(en, ew) | xor(en, enw)) > 0 THEN raw ELSE greatest(least(west, ne, n), least(greatest(west, ne, n), raw)) END AS mean,
  CASE WHEN abs(ene) > abs(m2) THEN ene ELSE m2 END AS most FROM (
 SELECT *, (((parts >> 1) - 1 + sub1 * v1 + sub2 * v2 + sub3 * v3 + sub4 * v4) * (16777216 // parts)) >> 24 AS raw, CASE WHEN abs(enw) > abs(m1) THEN enw ELSE m1 END AS m2 FROM (
 SELECT *, v1 + v2 + v3 + v4 AS parts FROM (
 SELECT *, a1 >> sh AS v1, a2 >> sh AS v2, a3 >> sh AS v3, a4 >> sh AS v4 FROM (
 SELECT *, greatest(length(bin(a1 + a2 + a3 + a4)) - 5, 0) AS sh FROM (
 SELECT *, {weight(1, w1)} AS a1, {weight(2, w2)} AS a2, {weight(3, w3)} AS a3, {weight(4, w4)} AS a4, west + ne - n AS sub1, n - (((ew + en + ene) * 16) >> 5) AS sub2, west - (((ew + en + enw) * 10) >> 5) AS sub3, n - ((7 * (enw + en + ene)) >> 5) AS sub4,
  CASE WHEN abs(en) > abs(ew) THEN en ELSE ew END AS m1 FROM (
 SELECT *, {", ".join(f"{sums(i + 1)} AS s{i}" for i in (1, 2, 3, 4))}, cw[1] AS ew, pn[1] AS en, CASE WHEN x = w - 1 THEN pn[1] ELSE pe[1] END AS ene, CASE WHEN x = 0 THEN pn[1] ELSE pw[1] END AS enw FROM (
 SELECT r.*, w, k % w AS x, cells[k + 1].v * 8 AS val, cells[k + 1].l * 8 AS west, cells[k + 1].t * 8 AS n, cells[k + 1].tr * 8 AS ne,
  p[k % w + 1] AS pn, p[k % w + 2] AS pe, p[k % w] AS pw, CASE WHEN k % w > 0 THEN c[k % w] ELSE {zero} END AS cw, CASE WHEN k % w > 1 THEN c[k % w - 1] ELSE {zero} END AS cww
 FROM run r JOIN held h USING (img, ty, tx) WHERE k < len(cells)))))))))))
SELECT img, ty * {GROUP} + (k - 1) // w AS y, tx * {GROUP} + (k - 1) % w AS x, cells[k].v AS v, prediction, error FROM run JOIN held USING (img, ty, tx) WHERE k > 0"""


@query(_weighted_sql())
def weighted_predictor(spark, d):
    return weighted.weighted(plane(spark, d), GROUP)


# ---- connected components

LOW, HIGH = 240, 320
_DOTS = f"""o AS MATERIALIZED (SELECT * FROM plane WHERE v > {LOW}),
e AS MATERIALIZED (SELECT a.img, a.y * 64 + a.x AS a, b.y * 64 + b.x AS b FROM o a JOIN o b ON a.img = b.img AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
reach AS (SELECT img, y * 64 + x AS a, y * 64 + x AS b FROM o UNION SELECT r.img, r.a, e.b FROM reach r JOIN e ON e.img = r.img AND e.a = r.b)"""


@query(f"""WITH RECURSIVE {PLANE}, {_DOTS}, l AS (SELECT img, b AS cell, min(a) AS label FROM reach GROUP BY img, b),
g AS (SELECT img, label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(v) AS peak, CAST(sum(v) AS BIGINT) AS total FROM l JOIN o USING (img) WHERE cell = y * 64 + x GROUP BY img, label)
SELECT img, label // 64 AS first_y, label % 64 AS first_x, n, x0, x1, y0, y1, peak, total FROM g WHERE peak > {HIGH} AND n <= 1000 AND x1 - x0 + 1 < 32 AND y1 - y0 + 1 < 32""")
def dot_components(spark, d):
    return blobs.dots(plane(spark, d), LOW, HIGH, tile=16)

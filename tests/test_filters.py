"""Blur, edge-preserving filter, score, matches, alias tables, splines and sessions against plain versions."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismal.operators import alias, blur, matches, scores, smoothing, splines
from prismal.streaming import sessions


@pytest.mark.parametrize(("sigma", "size"), [(1.5, 16), (4.0, 64), (0.8, 4096)])
def test_blocks_of_a_line_equal_the_recurrence(spark, sigma, size):
    draw = np.random.default_rng(3)
    lines = {7: draw.normal(0, 100, 1000), 8: draw.normal(0, 1, 3), 9: np.ones(size + 1)}
    df = spark.createDataFrame([(k, x, float(v)) for k, line in lines.items() for x, v in enumerate(line)], "line long, x long, v double").repartition(4)
    got = {(r.line, r.x): r.v for r in blur.lines(df, sigma, size).collect()}
    for k, line in lines.items():
        assert np.allclose([got[k, x] for x in range(len(line))], blur.sequential(line, sigma), atol=1e-6)
    assert len(got) == sum(map(len, lines.values()))
    assert math.isclose(sum(blur.kernel(sigma)), 1, abs_tol=1e-9)


def mirrored(n, k):
    k %= 2 * n
    return k if k < n else 2 * n - 1 - k


def plain_pass(v, sigma, stage):
    _, h, w = v.shape
    at = lambda c, y, x: v[c, mirrored(h, y), mirrored(w, x)]
    out = v.copy()
    offsets = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if 0 < abs(y) + abs(x) <= (2 if stage == 0 else 1)]
    patch = [(0, 0)] if stage == 2 else [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    for y, x in itertools.product(range(h), range(w)):
        s = sigma[y // 8, x // 8]
        if s < smoothing.LEAST_SIGMA:
            continue
        edge = 2 / 3 if y % 8 in (0, 7) or x % 8 in (0, 7) else 1
        factor = s * 1.65 * (0.9, 1, 6.5)[stage] * edge
        total, sums = 1.0, v[:, y, x].copy()
        for dy, dx in offsets:
            apart = sum((40, 5, 3.5)[c] * sum(abs(at(c, y + py, x + px) - at(c, y + py + dy, x + px + dx)) for py, px in patch) for c in range(3))
            weight = max(0, 1 + apart * factor)
            total += weight
            sums += weight * np.array([at(c, y + dy, x + dx) for c in range(3)])
        out[:, y, x] = sums / total
    return out


@pytest.mark.parametrize("shape", [(17, 18), (8, 33), (1, 5), (2, 2)])
def test_tiles_with_halos_equal_the_whole_plane(spark, shape):
    draw = np.random.default_rng(sum(shape))
    v = draw.normal(0, 0.3, (3, *shape))
    sigma = -draw.random((shape[0] // 8 + 1, shape[1] // 8 + 1)) * 0.2
    sigma[0, 0] = -5 if shape[0] > 2 else sigma[0, 0]
    rows = [(4, y, x, float(sigma[y // 8, x // 8]), *map(float, v[:, y, x])) for y, x in itertools.product(*map(range, shape))]
    df = spark.createDataFrame(rows, "img long, y long, x long, sigma double, v0 double, v1 double, v2 double").repartition(3)
    want = v
    for stage in (0, 1, 2):
        want = plain_pass(want, sigma, stage)
    got = np.zeros_like(v)
    for r in smoothing.edge_preserving(df, tile=8).collect():
        got[:, r.y, r.x] = r.v0, r.v1, r.v2
    assert np.allclose(got, want)


def test_equal_pictures_score_a_hundred_and_noise_lowers_it(spark):
    draw = np.random.default_rng(1)
    rows = []
    for img, noise in ((0, 0.0), (1, 0.02), (2, 0.2)):
        for y, x in itertools.product(range(17), range(24)):
            base = np.clip(0.5 + 0.4 * np.sin([x / 3, y / 5, (x + y) / 7]), 0, 1)
            rows.append((img, y, x, *map(float, base), *map(float, np.clip(base + draw.normal(0, 1, 3) * noise, 0, 1))))
    rows.append((3, 0, 0, *[0.5] * 6))  # too small for a scale
    df = spark.createDataFrame(rows, "img long, y long, x long, r1 double, g1 double, b1 double, r2 double, g2 double, b2 double")
    found = {r.img: r for r in scores.score(df, 64).collect()}
    assert abs(found[0].score - 100) < 1e-5 and 99.9 > found[1].score > found[2].score
    assert set(found) == {0, 1, 2} and found[0].scales == 3


@pytest.mark.parametrize("tile", [8, 16, 128])
def test_tiles_of_a_score_equal_whole_planes(spark, tile):
    """Sums of tiles with strips are those of planes blurred whole; samples are dealt once a scale, not once a plane, axis and block."""
    draw = np.random.default_rng(tile)
    shapes = {0: (19, 33), 1: (8, 8), 2: (40, 9)}
    planes = {img: draw.random((6, *shape)) for img, shape in shapes.items()}
    rows = [(img, y, x, shape[1], shape[0], *map(float, planes[img][:, y, x])) for img, shape in shapes.items() for y, x in itertools.product(*map(range, shape))]
    df = spark.createDataFrame(rows, "img long, y long, x long, w long, h long, r1 double, g1 double, b1 double, r2 double, g2 double, b2 double").repartition(3)
    errors = scores._errors(df, tile)
    got = {(r.img, r.c): r for r in errors.collect()}
    assert len(got) == 9 and errors._jdf.queryExecution().executedPlan().toString().count("Exchange REPARTITION") <= 1
    soft = lambda v: np.apply_along_axis(blur.sequential, 0, np.apply_along_axis(blur.sequential, 1, v, scores.SIGMA), scores.SIGMA)
    for img in shapes:
        for c, (a, b) in enumerate(zip(scores.positive(*planes[img][:3]), scores.positive(*planes[img][3:]), strict=True)):
            m1, m2, aa, bb, ab = map(soft, (a, b, a * a, b * b, a * b))
            structure = np.maximum(1 - (1 - (m1 - m2) ** 2) * (2 * (ab - m1 * m2) + scores.C2) / (aa - m1 * m1 + bb - m2 * m2 + scores.C2), 0)
            edge = (1 + abs(b - m2)) / (1 + abs(a - m1)) - 1
            want = [x for m in (structure, np.maximum(edge, 0), np.maximum(-edge, 0)) for x in (m.mean(), (m**4).mean() ** 0.25)]
            assert np.allclose([got[img, c][n] for n in scores.SUMS], want)


def longest(s, i, window, chain):
    """The longest match of a place among the nearest places that begin alike."""
    best, tried = (0, 0), 0
    for j in range(i - 1, max(-1, i - window - 1), -1):
        if s[j : j + 3] == s[i : i + 3] and len(s[i : i + 3]) == 3:
            tried += 1
            k = 0
            while i + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i - j)
            if tried == chain:
                break
    return best


def test_matches_equal_a_plain_search_on_short_texts():
    draw = random.Random(9)
    for _ in range(60):
        text = "".join(draw.choices("ab", k=draw.randrange(0, 80))) + draw.choice(["", "x" * 60, "abcabcabc" * 3])
        s = np.frombuffer(text.encode("utf-32-le"), "<u4")
        want, at = [], 0
        while at < len(text):
            k, d = longest(text, at, 32, 4)
            want.append((at, 0, k, d) if k >= 3 else (at, ord(text[at]), 0, 0))
            at += k if k >= 3 else 1
        assert list(matches.parsed(s, 32, 4)) == want


def test_texts_come_back(spark, monkeypatch):
    texts = [None, "", "a", "é中🙂" * 40, "x" * 70_000, "ab" * 3, " ".join(f"word{k % 91}" for k in range(30_000)), "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    found = matches.tokens(df, "id", "t")
    back = {r.key: r.text for r in matches.texts(found).collect()}
    assert back == {k: t for k, t in enumerate(texts) if t}
    assert found.filter("key = 4").count() < 20
    monkeypatch.setattr(matches, "SEGMENT", 50)
    s = np.frombuffer(texts[6][:5000].encode("utf-32-le"), "<u4")
    tokens = list(matches.parsed(s, 200, 4))
    assert matches.expanded(*([t[k] for t in tokens] for k in (1, 2, 3))) == texts[6][:5000]


def test_texts_side_by_side_are_parsed_as_alone(spark, monkeypatch):
    """A batch of texts gives the tokens of each, whichever are left to go alone, and texts come back without being dealt, with keys that repeat or are missing."""
    draw = random.Random(4)
    texts = ["", None, "a", "ab", "x" * 3000, *("".join(draw.choices("ab é🙂", k=draw.randrange(400))) * draw.randrange(1, 4) for _ in range(40))]
    keys = [draw.choice([None, 1, 2, 3]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts)], ["key", "t"])
    monkeypatch.setattr(matches, "SEGMENT", 700)
    monkeypatch.setattr(matches, "AHEAD", 40)
    want = []
    for key, t in zip(keys, texts, strict=True):
        s = np.frombuffer((t or "").encode("utf-32-le"), "<u4")
        want += [(key, *token) for token in matches.parsed(s, 100, 4)]
    for few, together in ((0, 1 << 22), (7, 2000), (1000, 1)):
        monkeypatch.setattr(matches, "FEW", few)
        monkeypatch.setattr(matches, "TOGETHER", together)
        got = list(matches._tokens(iter([batch]), 100, 4))
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
        for size in (3, 1 << 16):
            rows = [b.slice(k, size) for b in got for k in range(0, len(b), size)]
            back = [(r["key"], r["text"]) for b in matches._texts(iter(rows)) for r in b.to_pylist()]
            assert back == [(k, t) for k, t in zip(keys, texts, strict=True) if t]
    odd = spark.createDataFrame(list(zip(keys, texts, strict=True)), "id long, t string")
    found = matches.texts(matches.tokens(odd, "id", "t"), together=True)
    assert sorted(((r.key, r.text) for r in found.collect()), key=str) == sorted(((k, t) for k, t in zip(keys, texts, strict=True) if t), key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_alias_tables_give_each_symbol_its_count(spark):
    draw = random.Random(2)
    hists = {"one": {5: 9}, "two": {1: 1, 2: 10_000}, "flat": {k: 16 for k in range(256)}, "many": {k: draw.randrange(1, 900) for k in range(120)}, "over": {k: 1 for k in range(300)}}
    df = spark.createDataFrame([(c, s, n) for c, h in hists.items() for s, n in h.items()], "ctx string, sym long, n long")
    found = alias.normalized(df, "ctx").select("ctx", "dist", alias.table(F.col("dist")).alias("e")).cache()
    rows = {r.ctx: r for r in found.collect()}
    assert rows["over"].e is None and len(rows["many"].e) == 256
    each = found.filter("e is not null").select("ctx", "e", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("v")).select("ctx", alias.lookup(F.col("e"), F.col("v")).alias("g")).select("ctx", "g.*").collect()
    for ctx, h in hists.items():
        if ctx != "over":
            dist = rows[ctx].dist
            assert sum(dist) == 4096 and len(dist) == len(h)
            for s, n in enumerate(dist):
                mine = [(r.offset, r.freq) for r in each if r.ctx == ctx and r.symbol == s]
                assert sorted(mine) == [(k, n) for k in range(n)]


def test_marks_lie_a_step_apart_and_paint_what_plain_sums_do(spark):
    points = spark.createDataFrame([(0, 0, 3.0, 3.0), (0, 1, 20.0, 9.0), (0, 2, 20.0, 9.0), (0, 3, 5.0, 30.0), (1, 0, 10.0, 10.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 4.0)], "curve long, k long, x double, y double")
    found = splines.marks(points).orderBy("curve", "mark").collect()
    assert {r.curve for r in found} == {0, 2}
    straight = [(round(r.x, 6), round(r.y, 6), round(r.part, 6)) for r in found if r.curve == 2]
    assert straight[:5] == [(0, k, 1) for k in range(5)]
    for a, b in itertools.pairwise([r for r in found if r.curve == 0][:-1]):
        assert 0.8 < math.hypot(a.x - b.x, a.y - b.y) <= 1.000001
    strokes = spark.createDataFrame([(0, [1.0, 0.5], [0.2], [0.0], [1.5]), (2, [-1.0], [0.0], [0.3], [0.7, 0.1])], "curve long, color0 array<double>, color1 array<double>, color2 array<double>, sigma array<double>")
    brush = splines.brushes(splines.marks(points), strokes).cache()
    want = np.zeros((3, 36, 28))
    y, x = np.mgrid[0:36, 0:28]
    for r in brush.collect():
        for c in range(3):
            want[c] += r[f"c{c}"] * splines.painted(x, y, r.asDict())
    for tile, parts in ((8, 4), (64, 1)):
        got = np.zeros_like(want)
        for r in splines.canvas(brush, 28, 36, tile, parts).collect():
            got[:, r.y, r.x] = r.v0, r.v1, r.v2
        assert np.allclose(got, want)


def test_marks_are_painted_inside_their_reach_only(monkeypatch):
    """Work grows with the squares of the marks, not with marks times samples of a tile."""
    draw = np.random.default_rng(5)
    n = 300
    mark = {"x": draw.uniform(-4, 300, n), "y": draw.uniform(-4, 200, n), "sigma": draw.choice([-0.7, 0.5, 2.0], n), "reach": draw.uniform(0, 5, n), **{f"c{k}": draw.normal(0, 1, n) for k in range(3)}}
    counted, plain = [], splines._erf
    monkeypatch.setattr(splines, "_erf", lambda x: counted.append(x.size) or plain(x))
    monkeypatch.setattr(splines, "CHUNK", 1000)
    got = np.zeros((3, 180, 290))
    for b in splines._paint(iter([pa.RecordBatch.from_pydict({k: v[: n // 2] for k, v in mark.items()}), pa.RecordBatch.from_pydict({k: v[n // 2 :] for k, v in mark.items()})]), 64, 290, 180, 3):
        for r in b.to_pylist():
            got[:, r["y"], r["x"]] += r["v0"], r["v1"], r["v2"]
    assert sum(counted) <= 2 * n * 11 * 11
    want = np.zeros_like(got)
    y, x = np.mgrid[0:180, 0:290]
    for k in range(n):
        brush = {c: v[k] for c, v in mark.items()}
        weight = splines.painted(x, y, brush)
        for c in range(3):
            want[c] += brush[f"c{c}"] * weight
    assert np.allclose(got, want)


def test_a_late_frame_is_given_out_and_changes_no_slot(spark):
    begin = datetime(2024, 1, 1)
    frame = lambda hour, name, value, session=1: (session, begin + timedelta(hours=hour), name, "add", 1, 1, 1, value)
    folder = f"{sessions.shared(spark)}/late-{random.random()}"
    for rows in ([frame(5, 2, 10), frame(1, 1, 100)], [frame(40, 4, 1000)], [frame(3, 3, 7), frame(39, 5, 2)], [frame(400, 9, 0, 2)]):
        spark.createDataFrame(rows, sessions.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    found = {r.id: r for r in sessions.run(spark, folder, sessions.SCHEMA, "10 hours").collect()}
    assert found[3].late and found[3].canvas is None
    assert [(found[k].canvas, found[k].visible) for k in (1, 2, 5, 4)] == [(100, 1), (110, 2), (112, 3), (1112, 4)]


def test_sessions_of_a_stream_equal_a_batch(spark):
    draw = random.Random(6)
    begin = datetime(2024, 3, 1)
    rows = [(draw.randrange(4), begin + timedelta(minutes=draw.randrange(40_000)), k, draw.choice(["add", "replace", "keep"]), draw.randrange(4), draw.randrange(4), draw.randrange(2), draw.randrange(100)) for k in range(200)]
    folder = sessions.arrived(spark.createDataFrame(rows, sessions.SCHEMA), 4)
    found = sessions.run(spark, folder, sessions.SCHEMA, "20 days").filter("session >= 0").collect()
    want = {}
    for s in range(4):
        session = sessions.Session()
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            want[r[2]] = (session.draw(*r[3:]), session.visible, session.hidden, str(session.slots))
    assert {r.id: (r.canvas, r.visible, r.hidden, r.slots) for r in found} == want and not any(r.late for r in found)


def test_a_bucket_holds_many_sessions():
    """One call draws the frames of all its sessions, and its state goes on where it ended; frames without a value leave none."""

    class State:
        exists, get, timer, passed = False, None, None, 0

        def update(self, new):
            self.exists, self.get = True, new

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.timer = at

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.passed

    draw = random.Random(12)
    modes = ("add", "replace", "keep")
    frames = [(draw.randrange(50), draw.randrange(1000), k, draw.choice(modes), draw.randrange(4), draw.randrange(4), draw.randrange(2), draw.choice([None, *range(-50, 50)])) for k in range(2000)]
    state, out = State(), []
    for state.passed, part in ((0, frames[:900]), (0, frames[900:]), (500, []), (700, []), (2000, [(3, 5, -1, "add", 0, 0, 1, 7)])):
        rows = pd.DataFrame(part, columns=["session", *sessions.COLUMNS])
        for found in sessions.step((0,), iter([rows] if part else []), state):
            out += found.itertuples(index=False, name=None)
        assert state.timer is None or state.timer > state.passed or state.passed == 2000
    held = {k: sessions.Session() for k in range(50)}
    want = {}
    for s, _, name, *rest in sorted(frames, key=lambda r: r[:3]):
        canvas = held[s].draw(*rest)
        want[name] = (s, held[s].visible, held[s].hidden, canvas, held[s].text(), False)
    assert {r[1]: (r[0], *r[2:4], None if pd.isna(r[4]) else r[4], *r[5:]) for r in out if r[1] >= 0} == want
    assert [(r[0], r[6]) for r in out if r[1] < 0] == [(3, True)] and len(out) == len(frames) + 1

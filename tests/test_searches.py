"""Tree search, clusters, the self-correcting predictor and components against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from prismal.operators import blobs, clusters, symbols, tree_search, trees, weighted


def one_by_one(v):
    """The predictor sample after sample, as it is defined."""
    h, w = len(v), len(v[0])
    err = [[0] * w for _ in range(h + 1)]
    size = [[[0] * (w + 1) for _ in range(h + 1)] for _ in range(4)]
    out = [[0] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            west = v[y][x - 1] if x else v[y - 1][x] if y else 0
            n = v[y - 1][x] if y else west
            nw = v[y - 1][x - 1] if x and y else west
            ne = v[y - 1][x + 1] if y and x + 1 < w else n
            nn = v[y - 2][x] if y > 1 else n
            west, n, nw, ne, nn = (8 * a for a in (west, n, nw, ne, nn))
            right, before = min(x + 1, w - 1), max(x - 1, 0)
            tn, te, tw, t0 = err[y][x], err[y][right], err[y][before], err[y + 1][x - 1] if x else 0
            weights = []
            for i in range(4):
                s = size[i][y][x] + size[i][y][right] + size[i][y][before]
                shift = max((s + 1).bit_length() - 6, 0)
                weights.append(4 + (weighted.WEIGHTS[i] * ((1 << 24) // ((s >> shift) + 1)) >> shift))
            sub = [west + ne - n, n - ((t0 + tn + te) * 16 >> 5), west - ((t0 + tn + tw) * 10 >> 5), n - ((tw + tn + te) * 7 >> 5)]
            shift = max(sum(weights).bit_length() - 5, 0)
            weights = [a >> shift for a in weights]
            mean = ((sum(weights) >> 1) - 1 + sum(a * b for a, b in zip(sub, weights, strict=True))) * ((1 << 24) // sum(weights)) >> 24
            if ((tn ^ t0) | (tn ^ tw)) <= 0:
                mean = max(min(west, ne, n), min(max(west, ne, n), mean))
            out[y][x] = mean + 3 >> 3
            err[y + 1][x] = mean - 8 * v[y][x]
            for i in range(4):
                e = abs(sub[i] - 8 * v[y][x]) + 3 >> 3
                size[i][y + 1][x] = e
                size[i][y][x + 1] += e
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (2, 2), (17, 23), (40, 8)])
def test_weighted_predictor_equals_one_by_one(shape):
    draw = random.Random(sum(shape))
    v = [[draw.choice([0, 5, -300, draw.randrange(-2000, 2000)]) + 10 * x for x in range(shape[1])] for _ in range(shape[0])]
    assert weighted.predictions(np.array(v))[0].tolist() == one_by_one(v)


def test_groups_of_the_predictor_are_independent(spark):
    draw = random.Random(1)
    cells = [(img, y, x, draw.randrange(-500, 500)) for img in (0, 1) for y in range(21) for x in range(13)]
    found = weighted.weighted(spark.createDataFrame(cells, "img long, y long, x long, v long").repartition(3), 8).collect()
    got = {(r.img, r.y, r.x): r.prediction for r in found}
    grid = {c[:3]: c[3] for c in cells}
    for img, y0, x0 in itertools.product((0, 1), (0, 8, 16), (0, 8)):
        ys, xs = range(y0, min(y0 + 8, 21)), range(x0, min(x0 + 8, 13))
        assert [[got[img, y, x] for x in xs] for y in ys] == one_by_one([[grid[img, y, x] for x in xs] for y in ys])
    assert len(got) == len(cells)


def test_components_cover_tiles(spark):
    draw = random.Random(4)
    cells = [(0, y, x, 1 if draw.random() < 0.42 else 0) for y in range(40) for x in range(40)]
    cells += [(1, y, x, 1 if (y % 4 == 0) or (x == (0 if y % 8 < 4 else 39)) else 0) for y in range(40) for x in range(40)]  # a snake through all tiles
    found = blobs.components(spark.createDataFrame(cells, "img long, y long, x long, v long"), 0, tile=8).collect()
    on = {c[:3] for c in cells if c[3]}
    label = {}
    for c in sorted(on):
        if c not in label:
            label[c], todo = c, [c]
            while todo:
                i, y, x = todo.pop()
                for other in ((i, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                    if other in on and other not in label:
                        label[other] = c
                        todo.append(other)
    assert {(r.img, r.y, r.x): (r.img, r.label.y, r.label.x) for r in found} == label
    assert blobs.components(spark.createDataFrame([], "img long, y long, x long, v long"), 0).count() == 0


def cost(h):
    total = sum(h.values())
    return sum(n * math.log2(total / n) + 5 + math.floor(math.log2(max(n * 4096 // total, 1))) for n in h.values())


def test_best_clusters_equal_plain_rounds(spark):
    draw = random.Random(8)
    hists = {}
    for c in range(24):
        base = draw.choice([{1: 900, 2: 50}, {3: 500, 4: 500}, {5: 300, 1: 300, 3: 300}])
        hists[f"c{c:02}"] = {s: n + draw.randrange(0, 40) for s, n in base.items()} | {draw.randrange(6, 9): draw.randrange(1, 30)}
    df = spark.createDataFrame([(c, s, n) for c, h in hists.items() for s, n in h.items()], "ctx string, sym long, n long")
    f = lambda n: n * math.log2(n) if n else 0
    far = lambda a, b: round(f(sum(a.values()) + sum(b.values())) - f(sum(a.values())) - f(sum(b.values())) - sum(f(a[s] + b[s]) - f(a[s]) - f(b[s]) for s in a.keys() & b.keys()), 6)
    centres = [min(hists, key=lambda c: (-sum(hists[c].values()), c))]
    while len(centres) < 8:
        near = {c: 0 if c in centres else min(far(hists[c], hists[z]) for z in centres) for c in hists}
        new = min(near, key=lambda c: (-near[c], c))
        if near[new] < clusters.DISTINCT:
            break
        centres.append(new)
    of = {c: centres.index(c) if c in centres else min(range(len(centres)), key=lambda i: (far(hists[c], hists[centres[i]]), i)) for c in hists}
    assert {r.ctx: r.cluster for r in clusters.fast(df, 8).collect()} == of
    while True:
        held = {}
        for c, k in of.items():
            for s, n in hists[c].items():
                held.setdefault(k, {}).setdefault(s, 0)
                held[k][s] += n
        gains = {}
        for a, b in itertools.combinations(sorted(held), 2):
            joint = {s: held[a].get(s, 0) + held[b].get(s, 0) for s in held[a].keys() | held[b].keys()}
            gain = round(round(cost(joint), 6) - round(cost(held[a]), 6) - round(cost(held[b]), 6), 6)
            if gain < 0:
                gains[a, b] = gain
        best = {k: min((g, p) for p, g in gains.items() if k in p)[1] for k in held if any(k in p for p in gains)}
        merges = {p for p in gains if best.get(p[0]) == p == best.get(p[1])}
        if not merges:
            break
        of = {c: next((a for a, b in merges if b == k), k) for c, k in of.items()}
    assert {r.ctx: r.cluster for r in clusters.best(df, 8).collect()} == of


def test_tree_search_finds_the_planted_tests(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(3000):
        p, q = draw.randrange(8), draw.randrange(8)
        quiet = "a" if p > 3 else "b" if q > 5 else "c"
        rows.append((p, q, *itertools.chain.from_iterable((draw.randrange(2) if k == quiet else draw.randrange(12), 0 if k == quiet else 3) for k in "abc")))
    df = spark.createDataFrame(rows, "p long, q long, a_token long, a_bits long, b_token long, b_bits long, c_token long, c_bits long")
    found = tree_search.search(df, ["p", "q"], ["a", "b", "c"], levels=4)
    tree = tree_search.tree_of(found)
    assert not trees.check(tree)
    assert (tree.prop, tree.value) == ("p", 3) and (tree.other.prop, tree.other.value) == ("q", 5)
    assert (tree.more.predictor, tree.other.more.predictor, tree.other.other.predictor) == ("a", "b", "c")


def test_histograms_are_worked_out_once(spark):
    """However many centres are sought, and equal to those of the exploded characters."""
    times = spark.sparkContext.accumulator(0)

    def counted(batches):
        times.add(1)
        yield from batches

    rows = [(k, f"c{k % 5}" if k != 2 else None, t) for k, t in enumerate(["", None, "abc\n", "é中🙂🙂", "a" * 500, *("bcd" * k + "ef" * (40 - k) for k in range(40))])]
    docs = spark.createDataFrame(rows, "id long, ctx string, t string").coalesce(1)
    hist = symbols.text_histogram(docs.mapInArrow(counted, "id long, ctx string, t string"), "ctx", "t")
    want = symbols.histogram(symbols.of_text(docs, "id", "ctx", "t")).collect()
    assert sorted(hist.collect(), key=str) == sorted(want, key=str)
    before = times.value
    assert clusters.best(hist, 4).count() == clusters.fast(hist, 4).count() == 6
    assert times.value == before + 2

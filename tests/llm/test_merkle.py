"""The manifest against trees built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from prismal.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at string, n string, tree string, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    d, s, g, n, t = row
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, g, n if n is None else n + more, t)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path(made, i):
    return [(i >> k ^ 1 < i >> k, made[k][i >> k ^ 1] if i >> k ^ 1 < len(made[k]) else None) for k in range(len(made) - 1)]


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    trees = {g: levels([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    over = levels([trees[g][-1][0] for g in names])
    out = []
    for g in names:
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = path(trees[g], i) + path(over, names.index(g))
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for left, s in way:
                node = h(node) if s is None else h(s, node) if left else h(node, s)
            root = over[-1][0]
            out.append((r[0] if r[0] is not None else -1, own, trees[g][-1][0], root, h(*(s for _, s in way if s)), node, node == root))
    return sorted(out)


def found(spark, rows, height):
    df = spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA).repartition(5)
    longer = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(df, merkle.leaf(merkle.FIELDS, n_chars=longer), levels=height)
    return sorted((-1 if r.id is None else r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def sample():
    draw = random.Random(3)
    rows = [(k, draw.choice(["s", None, ""]), draw.choice(["en"] * 8 + ["de", "ü", None, ""]), draw.choice([None, 3, 99]), draw.choice(["x", None, "", "é" * 50])) for k in range(-20, 120)]
    return rows + rows[:5] + [rows[9]] * 3 + [(None, "s", "en", 1, "t")] * 4 + [(None, "s", "en", 2, "t"), (5, "s", "one", 1, "a"), (7, None, None, None, None)]


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_blocks_of_any_height_give_the_same_manifest(spark, height):
    assert found(spark, sample(), height) == brute(sample())


def test_a_single_row_and_none(spark):
    one = [(4, "s", "en", 1, "t")]
    assert found(spark, one, 12) == brute(one)
    assert found(spark, [], 12) == []


def test_traversal_holds_the_siblings_of_every_leaf():
    for n in [*range(1, 40), 64, 100]:
        leaves = [h(str(k)) for k in range(n)]
        made = levels(leaves)
        ways = list(merkle.paths(leaves, merkle.height_of(n, True, 12)))
        assert ways == [["" if s is None else ("L" if left else "R") + s for left, s in path(made, k)] for k in range(n)]
        assert {merkle.folded(x, w) for x, w in zip(leaves, ways, strict=True)} == {made[-1][0]}


def test_treehash_stacks_stay_logarithmic():
    t = merkle.Treehash([h(str(k)) for k in range(4096)], 0, 12)
    most = 0
    while not t.done:
        t.step()
        most = max(most, len(t.stack))
    assert most <= 13

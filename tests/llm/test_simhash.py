"""Fingerprints and links against counting and comparing all pairs."""

import random
import re

import pytest
import xxhash

from prismal.llm import simhash
from prismal.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def groups(prints, distance=2):
    """Index to the least index reachable, by all pairs."""
    parent = list(range(len(prints)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(k) for k in range(len(prints))]


def texts():
    draw = random.Random(11)
    words = [f"w{k}" for k in range(300)] + ["É", "ÀB", "x y"]
    out = [None, "", " \t\n", "one", "One", "two words", "two\x0bwords", "zero"]
    for _ in range(25):
        base = draw.choices(words, k=draw.choice([3, 40, 400]))
        out.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[draw.randrange(len(near))] = "changed"
            out.append("  ".join(near).upper())
    return out + out[8:20]


def test_classes_equal_all_pairs(spark):
    rows = texts()
    ids = [None if k == 9 else 1000 - k for k in range(len(rows))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, print string, node int").repartition(4)
    prints = [fingerprint(t) for t in rows]
    least = {}
    for i, g in zip(ids, groups(prints), strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    expected = sorted((-1 if i is None else i, f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, groups(prints), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(df).collect()) == expected
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, _, c in expected if i == c} | {None}
    assert simhash.one_of_each(df).columns == df.columns


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_links_of_crowded_buckets_join_up_what_all_pairs_do(spark, crowd):
    draw = random.Random(crowd)
    centres = [draw.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    prints = set()
    for c in centres:
        for _ in range(80):
            flips = [draw.randrange(64) for _ in range(draw.choice([1, 2, 3, 4, 9]))]
            prints.add(c ^ sum({1 << b for b in flips}))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    edges = simhash.links(nodes, crowd=crowd)
    found = {r.node: r.component for r in components(edges).collect()}
    got = {}
    for p in signed:
        got.setdefault(found.get(p, p), set()).add(p)
    expected = {}
    for p, g in zip(signed, groups(prints), strict=True):
        expected.setdefault(g, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 2 for r in edges.collect())


def test_a_long_text_in_pieces_and_an_empty_table(spark):
    text = " ".join(f"Word{k % 977}" for k in range(120_000)) + "\n" * 300_000 + "last"
    assert simhash.fingerprint(text.encode()) == fingerprint(text)
    assert simhash.fingerprint(b"x" * 2_000_000) == fingerprint("x" * 2_000_000)
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0

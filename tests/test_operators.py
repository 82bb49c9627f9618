"""Round trips and edge cases of the operators, on small frames."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismal.functions import scalar as S
from prismal.operators import planes, symbols, trees, verdicts
from prismal.sources import containers


def test_pack_signed_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (-3, -1, 0, 1, 2, 2**31, -(2**31))], "v long")
    u = S.pack_signed(F.col("v"))
    assert df.filter(S.unpack_signed(u) != F.col("v")).count() == 0
    assert [r.u for r in df.select(u.alias("u")).take(5)] == [5, 1, 0, 2, 4]


@pytest.mark.parametrize("config", [(4, 2, 0), (4, 1, 1), (2, 0, 0), (6, 2, 2)])
def test_hybrid_uint_is_reversible(spark, config):
    split, msb, lsb = config
    df = spark.createDataFrame([(v,) for v in [*range(300), 4095, 65537, 2**30 + 12345]], "v long")
    for r in df.select("v", S.hybrid_uint(F.col("v"), *config).alias("h")).collect():
        token, n, bits = r.h
        if token < 1 << split:
            assert r.v == token and n == 0
            continue
        t = token - (1 << split)
        low = t & (1 << lsb) - 1
        high = (t >> lsb) & (1 << msb) - 1
        e = split + (t >> msb + lsb)
        assert r.v == (((1 << msb | high) << (e - msb - lsb) | bits) << lsb | low), r


def test_empty_plane(spark):
    empty = spark.createDataFrame([], "img long, y long, x long, v long")
    assert planes.predict(empty, ["gradient"]).count() == 0
    assert planes.unsqueeze(planes.squeeze(empty)).count() == 0
    assert planes.tile_stats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=300))
def test_ans_round_trip(values):
    names, ids = np.unique(values, return_inverse=True)
    freq = symbols.normalized(np.bincount(ids))
    assert freq.sum() == 4096 and (freq > 0).all()
    state, words = symbols.ans_encode(ids.tolist(), freq)
    assert symbols.ans_decode(state, words, len(ids), freq) == (ids.tolist(), 0x130000)
    assert len(names) == len(freq)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60), st.integers(7, 15))
def test_huffman_lengths(counts, limit):
    used = [c for c in counts if c]
    depth = symbols.lengths_limited(counts, limit)
    assert max(depth, default=0) <= limit and [d > 0 for d in depth] == [c > 0 for c in counts]
    if len(used) > 1:
        assert sum(2.0**-d for d in depth if d) == 1


def test_trees():
    tree = trees.parse("if x > 3 - left 0 if x > 5 - top 1 - zero 0")
    assert trees.check(tree) == ["x > 5 is decided already"]
    for bad in ("if x > 3 - left 0", "- left 0 more", "if x < 3 - a 0 - b 0", ""):
        with pytest.raises(ValueError):
            trees.parse(bad)


def test_boxes_and_fragments(spark):
    part = lambda i, b: (len(b) + 12).to_bytes(4, "big") + b"jxlp" + i.to_bytes(4, "big") + b
    head = containers.SIGNATURE + containers.FTYP
    files = [(1, head + part(1 | 1 << 31, b"cd") + part(0, b"ab")), (2, head + part(0, b"ab") + part(2 | 1 << 31, b"cd")), (3, head + b"\0\0\0\x40jxlc"), (4, b""), (5, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in files], "file_id long, content binary")
    boxes = containers.scan_boxes(df)
    out = {r.file_id: r.codestream for r in containers.codestreams(boxes.filter("error is null")).collect()}
    assert out == {1: bytearray(b"abcd"), 2: None}
    assert [r.error for r in boxes.filter("file_id = 3 and error is not null").collect()] == ["past the end"]


def test_size_header():
    bits = lambda *fields: sum(v << s for v, s in fields).to_bytes(16, "little")
    assert containers.size_header(containers.CODESTREAM + bits((1, 0), (3, 1), (1, 6))) == (32, 32)
    assert containers.size_header(containers.CODESTREAM + bits((0, 0), (0, 1), (99, 3), (0, 12), (0, 15), (41, 17))) == (42, 100)


def test_raster_files(spark):
    s = bytes(range(12))
    files = [(1, containers.pgm(4, 3, s)), (2, containers.png(4, 3, s)), (3, b"P5\n# note\n9 9\n255\nshort"), (4, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in files], "file_id long, content binary")
    rows = containers.samples(df).orderBy("file_id", "y", "x").collect()
    assert [r.v for r in rows] == [*s, *s]


def test_verdict_order_and_mutations(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, n long")
    rules = [(F.col("n") > 40, verdicts.INDETERMINATE, "size_limit"), (F.col("n") > 4, verdicts.CORRUPT, "bad")]
    assert [(r.verdict, r.code) for r in verdicts.first_finding(df, rules).orderBy("id").collect()] == [("corrupt", "bad"), ("indeterminate", "size_limit"), ("valid", "none")]
    pairs = spark.createDataFrame([("abcd", "abcd"), ("abcd", "ab"), ("abcd", "abXd"), ("abcd", "XbcX"), ("", "")], "a string, b string")
    assert [r.kind for r in verdicts.mutation(pairs, "a", "b").collect()] == ["same", "truncate", "flip", "scatter", "same"]


def test_zigzag():
    order = planes.zigzag(8)
    assert [p[1:] for p in order[:6]] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]
    assert sorted(p[1:] for p in order) == [(y, x) for y in range(8) for x in range(8)]

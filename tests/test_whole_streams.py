"""The symbol coders over whole texts, long streams and large alphabets."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismal.operators import symbols
from prismal.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_ans_and_move_to_front_run_over_whole_texts(spark):
    texts = pd.read_parquet(f"{DATA}/documents.parquet").dropna(subset="text").set_index("doc_id").text
    found = catalog.QUERIES["ans_round_trip"](spark, DATA).toPandas().set_index("key")
    assert found.exact.all()
    assert {k: (r.n, r.alphabet) for k, r in found.iterrows()} == {k: (len(t), len(set(t))) for k, t in texts.items() if t}
    front = catalog.QUERIES["move_to_front_texts"](spark, DATA)
    ends = {k: (len(t), len(set(t))) for k, t in texts.items() if t}
    got = {r.key: (r.n, r.new) for r in front.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("index") == -1).alias("new")).collect()}
    assert got == ends
    for k in list(ends)[:3]:
        t = texts[k][:3000]
        want = [-1 if (p := t.rfind(c, 0, i)) < 0 else len(set(t[p + 1 : i])) for i, c in enumerate(t)]
        assert [r["index"] for r in front.filter((F.col("key") == k) & (F.col("pos") < len(t))).orderBy("pos").collect()] == want


def test_ans_of_a_large_alphabet(spark):
    """Over 4,096 symbols no table of 12 bits holds each."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("pos"), (F.col("id") * 7 % 9000).alias("sym"))
    r = symbols.ans_round_trip(rows).first()
    assert (r.n, r.alphabet, r.exact) == (20_000, 9000, True)
    ids = np.random.default_rng(1).permutation(200_000) % 70_000
    freq = symbols.normalized(np.bincount(ids), 1 << 17)
    assert symbols.ans_decode(*symbols.ans_encode(ids.tolist(), freq), len(ids), freq) == (ids.tolist(), 0x130000 << 1)


ODD = [("a" * 900 + "b", 1), ("", 2), (None, 3), ("é中🙂" * 400 + "ab" * 300, 4), ("".join(chr(0x4E00 + k * 7 % 5000) for k in range(9000)), 5), ("same", 6), ("other", 6), ("no key", None), *((f"line {k}\n" * (k % 40), 100 + k) for k in range(60))]


def odd(spark):
    """Texts with repeated and missing keys, and alphabets of one to 5,000 symbols."""
    return spark.createDataFrame(ODD, "t string, key long").coalesce(1)


@pytest.mark.parametrize(("name", "held"), [("move_to_front_texts", 0), ("ans_round_trip", 0)])
def test_texts_are_coded_where_they_are_read(spark, name, held):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == held


def test_move_to_front_of_odd_texts(spark):
    rows = [(r.key, r.pos, r["index"]) for r in symbols.move_to_front_texts(odd(spark), "key", "t").collect()]
    want = [(key, pos, index) for t, key in ODD if t for pos, index in enumerate(symbols._front_list(list(t)))]
    assert rows == want
    ids = np.random.default_rng(2).integers(0, 9, 3000) ** 2
    whole = symbols._front_pieces(ids, np.array([1, 2000, 999]), 65)
    assert whole.tolist() == [x for a, b in ((0, 1), (1, 2001), (2001, 3000)) for x in symbols._front_list(ids[a:b].tolist())]


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_ans_of_odd_texts(spark, monkeypatch, few):
    """Streams side by side give what each gives alone, whatever is left to go symbol by symbol."""
    monkeypatch.setattr(symbols, "FEW", few)
    batch = pa.RecordBatch.from_arrays([pa.array([k for _, k in ODD], pa.int64()), pa.array([t for t, _ in ODD])], ["key", "t"])
    rows = [tuple(r.values()) for b in symbols._ans(iter([batch])) for r in b.to_pylist()]
    want = []
    for t, key in ODD:
        if t:
            names, ids = np.unique([ord(c) for c in t], return_inverse=True)
            freq = symbols.normalized(np.bincount(ids), 1 << max(12, len(names).bit_length()))
            want.append((key, len(t), len(names), len(symbols.ans_encode(ids.tolist(), freq)[1]), True))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_a_stream_that_does_not_come_back_is_told(monkeypatch):
    monkeypatch.setattr(symbols, "FEW", 0)
    ids, freq = np.arange(3000) % 7, symbols.normalized(np.bincount(np.arange(3000) % 7))
    assert symbols._ans_streams(ids, np.array([3000]), [freq])[1].all()
    bad = freq.copy()
    bad[0] = 0  # a symbol without a share of the table
    with np.errstate(all="ignore"):
        assert not symbols._ans_streams(ids, np.array([3000]), [bad])[1].any()

"""Packing with more sources than any fixed number of queues."""

import numpy as np

from prismal.llm import bpe, packing


def test_every_source_keeps_its_own_queue_and_weight(spark):
    """1,100 sources of like size, which are all served at the same virtual times; only one is larger."""
    n = 1100
    docs = spark.createDataFrame([(k, "a b c d e " * 20 * (20 if k == 7 else 1), f"s{k}") for k in range(n)], "doc_id long, text string, source string").repartition(3)
    path = bpe.vocabulary("byte_bpe_50k.json")
    weighted = packing.pack(docs, path, "byte", 1, length=8192, weights={"s7": 200.0, "s8": 1.0}).toPandas()
    first = weighted[weighted.sequence_id == 0].groupby("source").length.sum()
    assert abs(first["s7"] - 8192 * 200 / (200 + n - 1)) <= 100  # half a unit of virtual time
    plain = packing.pack(docs, path, "byte", 1, length=1024).toPandas()
    assert (plain.groupby("doc_id").length.sum() == plain.groupby("doc_id").doc_tokens.first()).all()
    for s, g in plain.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
    share = (plain.groupby("source").length.sum() / plain.length.sum()).drop("s7")
    given = plain[plain.sequence_id < 20].groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0).reindex(columns=share.index, fill_value=0)
    assert np.abs(given.to_numpy() - 1024 * share.to_numpy()).max() < 2

"""Steps that only mark rows do not deal the texts, and bands of the same lines are looked up once."""

import numpy as np

from prismal.llm import line_dedup, ngram_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_removed_lines_are_broadcast_and_beyond_the_limit_the_rows_are_the_same(spark, monkeypatch):
    df = docs(spark, [f"one line of all\nand line {k} alone" for k in range(30)] + [None, ""])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = line_dedup.dedup(df, min_chars=1)
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        monkeypatch.setattr(line_dedup, "BROADCAST", -1)
        dealt = line_dedup.dedup(df, min_chars=1)
        assert "SortMergeJoin" in plan(dealt) and sorted(dealt.collect(), key=str) == sorted(found.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ids_that_go_are_few_and_texts_stay(spark):
    rng = np.random.default_rng(2)
    base = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30)) for _ in range(6)]
    df = docs(spark, base + [base[0], base[3]]).union(spark.createDataFrame([(None, base[1]), (20, None)], "doc_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join.one_of_each(df)
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert sorted((r.doc_id for r in found.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 20, None], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bands_of_the_same_lines_are_looked_up_once(spark, monkeypatch):
    """Five equal signatures make every band the same: one is left."""
    counts = {}
    monkeypatch.setattr(line_dedup, "table", lambda df, name, f=line_dedup.table: (counts.__setitem__(name, f(df, name)), counts[name])[1])
    monkeypatch.setattr(line_dedup, "drop_table", lambda df: None)
    rest = "".join(np.random.default_rng(4).choice(list("abcdefgh"), 40))
    lines = spark.createDataFrame([(k, rest * (k + 2)) for k in range(5)], "line long, norm string")
    comp = line_dedup.linked(lines, 12, 0.8)
    assert counts["large-buckets"].count() == 1 and comp.select("component").distinct().count() == 1

"""Tables that a step writes on the way are deleted, those that its result reads stay."""

import os

from prismal.llm import common, line_dedup


def folders(spark):
    return {x.rsplit("-", 1)[0] for x in os.listdir(common.shared_dir(spark).removeprefix("file://"))}


def test_line_dedup_leaves_only_what_its_result_reads(spark):
    for x in os.listdir(common.shared_dir(spark).removeprefix("file://")):
        common.delete(spark, common.shared_dir(spark) + "/" + x)
    text = "\n".join(f"a line of the text with the number {k}" for k in range(5))
    found = line_dedup.dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), min_chars=1)
    assert "gone" in folders(spark) and not folders(spark) & {"lines", "texts", "bitmaps", "buckets", "pairs", "links", "components", "edges"}
    assert {r.doc_id: r.n_removed for r in found.collect()}[2] == 5


def test_tables_handed_on_outlive_an_inner_scratch_only(spark):
    with common.scratch(spark) as outer:
        with common.scratch(spark) as inner:
            a, b = (common.table(spark.range(3), x) for x in ("one", "two"))
            inner(a)
        assert a.count() == 3 and "two" not in folders(spark)
        c = outer(common.table(a, "three"))
    assert c.count() == 3 and "one" not in folders(spark)

"""The pipeline over nulls, empty and repeated rows, columns that clash, and an empty table."""

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _lines int, component string, token long"
WORDS = "the old bridge over the river was closed on monday because the water rose again and nobody in the town could cross it for a week or so"


def rows():
    line = lambda k: " ".join(f"{w}{k}" for w in WORDS.split())
    out = [(k, f"{line(k)}\n{line(k + 500)}", "en", "s1", 300) for k in range(12)]
    out += [(20, line(3) + " and more of it, told at length, so that it is another text", "en", "s1", 9), (21, None, None, None, None), (22, "", "en", "s2", 0), (None, line(77), "fr", None, 4), (None, None, "fr", "s1", 4)]
    out += [out[0], out[0], (30, "one\ntwo", "en", "s2", 7), (31, "é" * 30_000, "xx", "s3", 30_000)]
    return [(*r, "x", 1, "y", 2) for r in out]


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame([(k, int(k == 1), int(k % 4 == 1)) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = "".join(f"{w}7 " for w in WORDS.split()[:15])
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def through(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            continue  # a classifier of eight labels says nothing; it is run below
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == names and docs.count() <= before
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_each_stage_does_what_it_says_to_odd_rows(spark, folder):
    kept, packed = through(spark, folder, spark.createDataFrame(rows(), COLUMNS).repartition(3))
    ids = {name: {i for i, _ in found} for name, found in kept.items()}
    assert {21, 22} <= ids["line dedup"] and None in ids["line dedup"]
    texts = [t for i, t in kept["n-gram Jaccard join"] if i == 0]
    assert len(texts) == 1  # three equal rows become one
    assert {21, 22, None} <= ids["n-gram Jaccard join"]
    assert 7 in ids["n-gram Jaccard join"] and 7 not in ids["benchmark decontamination"] and 8 in ids["benchmark decontamination"]
    assert {r.doc_id for r in packed} == ids["benchmark decontamination"]
    for r in packed:
        assert r.start + r.length <= r.doc_tokens
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_an_empty_table_goes_through(spark, folder):
    kept, packed = through(spark, folder, spark.createDataFrame([], COLUMNS))
    assert packed == [] and not any(kept.values())
    assert corpus_pipeline.run(spark, folder).count() == 0

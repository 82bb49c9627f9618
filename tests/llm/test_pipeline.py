import corpus_pipeline
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, FOLDER).toPandas()
    key = ["sequence_id", "offset"]
    assert len(whole) == len(packed) and whole["length"].sum() == packed["length"].sum()
    pd.testing.assert_series_equal(whole.groupby("sequence_id")["length"].sum(), packed.groupby("sequence_id")["length"].sum())
    assert not whole.duplicated(key).any()

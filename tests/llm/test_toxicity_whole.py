"""Training reads every labelled row, however many there are."""

import numpy as np

from prismal.llm import toxicity


def test_words_of_every_labelled_row_are_learnt(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(50)]
    bad = [f"slur{'abcdefghij'[k]}" for k in range(8)]
    made = [(k, " ".join([*rng.choice(words, 6), *([bad[k // 4 % 8]] if k % 4 == 0 else [])]), "en", int(k % 4 == 0)) for k in range(9000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, toxic int").repartition(3)
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), epochs=2)
    held = sum(1 for r in df.selectExpr("pmod(xxhash64(doc_id), 5) = 0 as h").collect() if r.h)
    n = toxicity.train.__defaults__[0]
    assert held < 9000 - n  # more rows are used than one part has
    found = toxicity.score(df, model).join(df, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in found]) >= 0.99
    assert model.thresholds.keys() == {"en"}


def test_words_of_eight_rows_among_many_are_known(spark):
    """Each of ten words is in eight rows of 12,000 that aren't set aside: all ten have embeddings of their own only if every row counts."""
    df = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic", "pmod(xxhash64(id), 5) <> 0 as kept")
    kept = sorted(r.doc_id for r in df.filter("kept").collect())[:80]
    words = [f"seldom{'abcdefghij'[k]}" for k in range(10)]
    held = {d: words[k % 10] for k, d in enumerate(kept)}
    rows = [(k, "plain text " + held.get(k, "") + (" vile" if k % 3 == 0 else ""), "en") for k in range(12_000)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), df.select("doc_id", "toxic"), epochs=1)
    assert all(toxicity.bucket(w) in model.rows for w in words)

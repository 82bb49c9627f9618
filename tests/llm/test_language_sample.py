"""The sample of the language model where one language has nearly all rows, and its sums over whole words."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prismal.llm import language


def test_a_rare_language_has_rows_and_copies_count_once(spark):
    rows = [("en", f"text {k % 3000}") for k in range(9000)] + [("fr", f"texte {k}") for k in range(5)] + [(None, "x"), ("de", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7).withColumn("h", F.lit(1))
    got = Counter(r.lang for r in language.sample(df, 100).collect())
    assert got == {"en": 95, "fr": 5}
    again = {r.text for r in language.sample(df.repartition(2), 100).collect()}
    assert again == {r.text for r in language.sample(df, 100).collect()}
    assert language.sample(df.limit(0), 10).count() == 0
    few = language.sample(spark.createDataFrame([(f"l{k}", "t") for k in range(20)], "lang string, text string"), 4)
    assert few.count() == 20


def test_fitting_sums_over_the_whole_of_a_long_word():
    model = language.Model(["x"], ["a", "b", "ab", "aba", "▁"])
    rng = np.random.default_rng(2)
    for word in ("▁abaab", "▁" + "ab" * 20):
        prob = rng.random(6).tolist()
        edges, size = model.edges(word), len(word)
        a, b = [1.0] + [0.0] * size, [0.0] * size + [1.0]
        for i, j, k in edges:
            a[j] += a[i] * prob[k]
        for i, j, k in reversed(edges):
            b[i] += prob[k] * b[j]
        want = [(k, a[i] * prob[k] * b[j] / b[0]) for i, j, k in edges]
        got = list(language.posterior(edges, size, prob))
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    model.fit({"x": {"▁" + "ab" * 20_000: 1, "▁ab": 3}}, rounds=1)
    assert np.isfinite(model.p).all()

"""Each distinct word is scored once, by the substrings that the vocabulary knows, and the sample is full."""

import numpy as np

from prismal.llm import language


def test_a_word_is_scored_once_however_it_is_written(monkeypatch):
    model = language.Model(["de", "en"], ["haus", "h", "a", "▁", "▁haus"])
    asked, real = [], language.Model.log_likelihood
    monkeypatch.setattr(language.Model, "log_likelihood", lambda self, words: asked.extend(words) or real(self, words))
    s = language.Scorer(model)
    ll, n = s.score(["Haus, haus. (HAUS) haus! x²haus", "", "12 haus-a"])
    assert sorted(asked) == ["▁a", "▁haus", "▁haus", "▁x"] and n.tolist() == [6, 0, 2]  # x²haus is one run of two words
    want = real(model, ["▁haus", "▁x", "▁a"])
    assert np.allclose(ll, [5 * want[0] + want[1], [0, 0], want[0] + want[2]])
    again = language.scorer(model)
    assert language.scorer(model) is again and language.scorer(language.Model([], [])) is not again


def test_the_trie_gives_the_sums_over_all_segmentations():
    rng = np.random.default_rng(4)
    vocabulary = sorted({"".join(rng.choice(list("abé東"), n)) for n in rng.integers(1, 6, 60)} | {"▁", "▁ab"})
    model = language.Model(["x", "y", "z"], vocabulary)
    model.p[1:] = rng.random((len(vocabulary), 3))
    words = ["▁" + "".join(rng.choice(list("abé東q"), n)) for n in rng.integers(1, 40, 300)] + ["", "\U0001f600a"]
    for word, got in zip(words, model.log_likelihood(words), strict=True):
        alpha = [np.ones(3)] + [np.zeros(3)] * len(word)
        for i, j, k in sorted(model.edges(word)):
            alpha[j] = alpha[j] + alpha[i] * model.p[k]
        assert np.allclose(got, np.log(alpha[-1]))


def test_the_sample_is_full_with_few_ranges_and_many(spark, monkeypatch):
    df = spark.createDataFrame([(f"text {k}", "en") for k in range(300)] + [("texte", "fr")], "text string, lang string")
    for bins in (1, 16, 1 << 14):
        monkeypatch.setattr(language, "BINS", bins)
        assert len({tuple(r) for r in language.sample(df, 40).collect()}) == 40

"""Letters, long words, clashing names and the tokenizer's own ids."""

import zlib

import numpy as np

from prismal.llm import bpe, decontaminate, language, line_quality, packing


def test_only_letters_make_a_word():
    assert language.letters("² ½ ①") == [] and language.letters("ⅷ") == [] and language.letters("x²y été") == ["x", "y", "été"]


def test_long_words_sum_over_the_whole_word():
    model = language.Model(["x", "y"], ["a", "b", "ab", "aba", "▁"])
    model.p[1:] = np.random.default_rng(1).random((5, 2))
    for word in ("ab" * 30, "aab" * 14):
        alpha = [np.ones(2)]
        for j in range(1, len(word) + 1):
            alpha.append(sum((alpha[i] * model.p[model.index[word[i:j]]] for i in range(max(0, j - 3), j) if word[i:j] in model.index), np.zeros(2)))
        assert np.allclose(model.log_likelihood([word])[0], np.log(alpha[-1]))
    assert np.isfinite(model.log_likelihood(["c" * 5000])).all()


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, _id int, _key int, _gone int, n_removed int")
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontaminate.drop_contaminated(df, bench).collect() == df.collect()
    assert line_quality.clean(df).columns == df.columns


def test_pieces_hold_the_ids_of_the_tokenizer_in_the_order_of_service(spark):
    texts = ["one two three " * 50, "four, five! " * 90, None, "six " * 10, "été 中文 " * 40]
    docs = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    path = bpe.vocabulary("byte_bpe_50k.json")
    tok = bpe.Encoder(path, "byte").tok
    for weights in (None, {"s0": 1.0, "s1": 5.0}):
        found = packing.pack(docs, path, "byte", 1, length=64, weights=weights).toPandas()
        for k, t in enumerate(texts):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            mine = found[found.doc_id == k].sort_values("start")
            assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
        if weights:
            first = found[found.sequence_id == 0].groupby("source").length.sum()
            assert abs(first["s1"] - 64 * 5 / 6) <= 2

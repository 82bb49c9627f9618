"""A large group of near copies of which most pairs stay under the threshold: pairs that are fetched and compared stay few."""

import random

import numpy as np

from prismal.llm import ngram_join


def test_pairs_of_a_group_of_near_copies_stay_in_proportion(spark, monkeypatch):
    rng, base = random.Random(5), [f"word{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 3, 4))):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    compared, plain = [], ngram_join.table

    def counted(df, name):
        out = plain(df, name)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "table", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4, percent=85).collect()}
    sets = [set(ngram_join.shingles(t.encode(), 4).tolist()) for t in texts]
    want = list(range(150))
    for _ in range(150):
        new = [min(want[j] for j in range(150) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in range(150)]
        if new == want:
            break
        want = new
    assert [got[k] for k in range(150)] == want and 20 < len(set(want)) < 150
    assert sum(compared) < 10 * len(texts)


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for size in (1, 50, 700, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, size, "u8"))
        b = np.unique(np.concatenate([a[: size * 9 // 10], rng.integers(0, 1 << 63, size // 10 + 1, "u8")]))
        differ = sum(int(x).bit_count() for x in (ngram_join.parities(a) ^ ngram_join.parities(b)).view("u8"))
        assert differ <= len(np.setxor1d(a, b)) and (differ + len(np.setxor1d(a, b))) % 2 == 0

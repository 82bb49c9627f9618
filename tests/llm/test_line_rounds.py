"""Rounds of the line operator: none where bands hold two or three lines, and the same links however many there are."""

import numpy as np
import pytest

from prismal.llm import components, line_dedup


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that a step writes."""
    names = []
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "table", lambda df, name, f=module.table: (names.append(name), f(df, name))[1])
    return names


def near(rng, copies, n=30):
    base = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(n)]
    return [" ".join(w[:-1] + "0" if k == at else w for k, w in enumerate(base)) for at in range(copies)]


def removed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r.n_removed for r in line_dedup.dedup(df, min_chars=1).orderBy("doc_id").collect()]


def test_bands_of_two_and_three_lines_take_no_round(spark, written):
    rng = np.random.default_rng(5)
    assert removed(spark, near(rng, 2) + near(rng, 3) + near(rng, 1)) == [0, 1, 0, 1, 1, 0]
    assert "mixed" not in written and written.count("links") == 1


def test_links_are_the_same_with_all_rounds_and_with_the_least(spark, written, monkeypatch):
    """Groups that share large bands, each band with lines of several groups."""
    monkeypatch.setattr(line_dedup, "BANDS", ((), *line_dedup.BANDS[:3]))
    monkeypatch.setattr(line_dedup, "AFFORDABLE", 1000)
    rng = np.random.default_rng(6)
    lines = [x for n in (9, 6, 2, 1, 1, 5) for x in near(rng, n)]
    want = [int(k > 0) for n in (9, 6, 2, 1, 1, 5) for k in range(n)]
    assert removed(spark, lines) == want
    few = written.count("mixed")
    monkeypatch.setattr(line_dedup, "AFFORDABLE", 0)
    written.clear()
    assert removed(spark, lines) == want
    assert few == 2 < written.count("mixed")


def test_components_that_are_stars_take_no_round(spark, written):
    found = components.components(spark.createDataFrame([(5, 1), (1, 6), (9, 2), (5, 1), (7, 7)], "u long, v long"))
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (9, 2)}
    assert written == ["edges"]
    chain = components.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "u long, v long"))
    assert {(r.node, r.component) for r in chain.collect()} == {(k, 0) for k in range(21)}

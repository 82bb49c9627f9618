"""Features of whole blocks and paths, and a training sample that every language is in."""

import time

import numpy as np

from prismal.llm import bpe, html_text, language


def test_features_read_the_whole_block_and_path():
    words = [f"w{k}" for k in range(900)]
    page = lambda middle, outer: f"<div class={outer}>" + "<section>" * 40 + " ".join(words[:450] + [middle] + words[450:])
    a, b, c = (html_text.features(html_text.blocks(page(*x)))[0] for x in (("one", "x"), ("two", "x"), ("one", "comments")))
    p, w = html_text.PATH_DIM, html_text.PATH_DIM + html_text.WORD_DIM
    assert np.abs(a[p:w] - b[p:w]).max() > 0 and (a[:p] == b[:p]).all()
    assert np.abs(a[:p] - c[:p]).max() > 0.01
    every = np.mean([html_text._WORDS[html_text._ROWS[x]] for x in [*words, "one"]], 0)
    assert np.allclose(a[p:w], every, atol=1e-5)


def test_a_rare_language_is_in_the_sample(spark):
    rows = [(f"the house number {k}", "en") for k in range(400)] + [("the same text", "en")] * 400 + [("das haus und der garten", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    found = language.sample(df, 20).collect()
    assert len(found) == len(set(found)) == 20 and [r.text for r in found if r.lang == "de"] == ["das haus und der garten"]
    assert language.train(df, bpe.vocabulary("piece_bpe_32k.model"), 20).langs == ["de", "en"]


def test_hostile_pages_take_linear_time_and_leave_no_markup():
    """Deep, unclosed and odd-quoted pages; a quote that isn't behind an equals sign ends with its tag."""
    for page in ("<a " * 40_000 + '"', "<div>x" * 40_000, "<div>" * 40_000 + "</x>" * 40_000, '<a x="' * 40_001, "<p>" * 40_000 + "</p>" * 40_000):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 5
    assert [t for t, _, _ in html_text.blocks('<p title="a"b">Hello world</p><p x=\'>\'>a > b</p>')] == ["Hello world", "a > b"]


def test_features_are_those_of_every_word():
    long = " ".join(f"word{k}," for k in range(5000))
    a, b = (html_text.features(html_text.blocks(f"<p>{t}</p>"))[0] for t in (long, long + " other"))
    rows = html_text._WORDS[[html_text._ROWS[w] for w in long.split()]]
    at = slice(html_text.PATH_DIM, html_text.PATH_DIM + html_text.WORD_DIM)
    assert np.allclose(a[at], rows.mean(0), atol=1e-5) and not np.allclose(a[at], b[at], atol=1e-9)
    assert not html_text.features(html_text.blocks("<p>?!</p>"))[0][at].any()

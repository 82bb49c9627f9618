"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.llm import bpe, components, decontaminate, html_text, language, line_dedup, line_quality, ngram_join, packing, substring_dedup, token_files, toxicity

LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(6000))
BASE = "the quick brown fox jumps over the lazy dog while nine grey cats look on from a very old stone wall near the river bank at dusk"
TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "b"),
    (2, BASE, "en", "b"),
    (3, BASE.replace("grey", "white"), "en", "a"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", "en", "a"),
    (7, LONG, "en", "a"),
    (8, LONG + " tail", "en", None),
    (9, "ÉTÉ été İstanbul ß 中文 текст 🙂 <|endoftext|> don't\r\nx\x0by", "fr", "c"),
    (10, "one two", "en", "a"),
    (None, "no id at all here", "en", "a"),
    (11, "x" * 30_000, "en", "a"),
    (12, "\n".join([BASE] * 3 + ["short", "short", ""]), "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, text_key string, key long, n long, spans int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "clash", 7, 8, 9) for t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) if not isinstance(x, list) else str(x) for x in r))


def test_token_files(docs, empty):
    path = bpe.vocabulary("word_bpe_49k.json")
    manifest = token_files.write(docs, path, "word", 1)
    found = token_files.read(manifest).orderBy("start").collect()
    tok = bpe.Encoder(path, "word").tok
    at = 0
    want = sorted(((-1 if i is None else i), t or "") for i, t, *_ in TEXTS)
    assert len(found) == len(want)
    for r, (i, t) in zip(found, want, strict=True):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sum(len(x) for _, x in token_files.ids_of(manifest)) == at
    assert token_files.read(token_files.write(empty, path, "word", 1)).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_packing(docs, empty, weights):
    path = bpe.vocabulary("byte_bpe_50k.json")
    found = packing.pack(docs, path, "byte", 1, length=256, weights=weights, emit_ids=True).toPandas()
    tok = bpe.Encoder(path, "byte").tok
    total = Counter((-1 if i is None else i) for i, *_ in TEXTS)
    size = {(-1 if i is None else i): len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in TEXTS}
    for i, g in found.groupby(found["doc_id"].fillna(-1)):
        assert g["length"].sum() == total[i] * size[i] and set(g["doc_tokens"]) == {size[i]}
    for s, g in found.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
        assert g["length"].sum() == 256 or s == found["sequence_id"].max()
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(found["ids"], found["ids_crc32"], strict=True))
    assert packing.pack(empty, path, "byte", 1).count() == 0


def test_packing_keeps_the_mixture():
    totals, rates = np.array([1000, 37, 5000, 3]), np.array([1000.0, 37, 5000, 3])
    w = np.arange(0, 49)
    given = packing.served(w, 128, totals, rates)
    assert (given.sum(0) == np.minimum(w * 128, totals.sum())).all() and (np.diff(given, axis=1) >= 0).all()
    assert np.abs(given - np.outer(totals / totals.sum(), np.minimum(w * 128, totals.sum()))).max() < 2


def test_line_quality(docs, empty):
    found = {(r.doc_id, r.n_words): r for r in line_quality.verdicts(docs).collect()}
    assert line_quality.verdicts(docs).count() == len(TEXTS) and line_quality.verdicts(empty).count() == 0
    for i, t, *_ in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = found[i, len(w)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(grams)
        rep = {k + o for k, g in enumerate(grams) if c[g] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)), i


def test_frequent_lines_of_a_host(spark):
    menu = "home about contact"
    text = lambda k: "\n".join([menu, *(" ".join("abcdefghijklmnopqrstuvwxyzABCDEF"[k] + "vwxyzt"[j] + "lmnopqrstuvw"[i] for i in range(12)) for j in range(6))])
    df = spark.createDataFrame([(k, text(k), "h") for k in range(26)] + [(99, "\n".join([menu] * 40), "h")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in line_quality.verdicts(df).collect()}
    assert found[3].removed_lines == [0] and found[3].kept and not found[99].kept
    assert menu not in line_quality.clean(df).filter("doc_id = 3").first().text


def test_line_dedup(docs, empty, spark):
    assert line_dedup.dedup(empty).count() == 0
    out = {(r.doc_id, k): r for k, r in enumerate(line_dedup.dedup(docs).orderBy("doc_id").collect())}
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out.values()}
    assert by_id[1].text == BASE and by_id[2].text == "" and by_id[4].text is None and by_id[5].text == ""
    assert by_id[12].text == "short\nshort\n" and by_id[12].n_removed == 3
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    chain = [a, a.replace("gamma", "gammb"), a.replace("gamma", "gammb").replace("omega", "omegb"), "nothing like the others at all, not a bit"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(chain)], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup(df).orderBy("doc_id").collect()] == [a, "", "", chain[3]]


def test_substring_dedup(docs, empty, spark):
    size = 40
    extra = [(20, "é" * 100, None, None), (21, "ab" * 100, None, None), (22, BASE[10:] + "!", None, None), (23, BASE[:39], None, None)]
    df = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(i, t, 1) for i, t, *_ in extra], "doc_id long, text string, key long"))
    every = [(i, t or "") for i, t, *_ in [*TEXTS, *extra]]
    seen = Counter()
    for _, t in every:
        b = t.encode()
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    want = []
    for i, t in every:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for heavy in (20_000, 1):
        found = substring_dedup.removed(df, size=size, heavy=heavy).drop("spans").collect()
        assert Counter(map(tuple, found)) == Counter(want)
    assert substring_dedup.removed(empty, size=size).count() == 0


def test_decontamination(docs, empty, spark):
    items = [(1, "Lazy DOG while nine grey cats look on from a very old"), (2, "one two"), (3, None), (4, "never seen anywhere"), (1, "Lazy DOG while nine grey cats look on from a very old")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    want = Counter()
    for i, t, *_ in TEXTS:
        w, hit, names = split(t), set(), set()
        for item, x in items:
            v = split(x)
            for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(str(item))
        want[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    found = decontaminate.report(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(map(tuple, found.collect())) == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {3, 4, 5, 6, 7, 8, 9, None, 11}
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, empty, n, percent):
    kept = [(i, t) for i, t, *_ in TEXTS if i is not None]
    sets = {}
    for i, t in kept:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.permutations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                least[a] = min(least[a], least[b])
    found = ngram_join.classes(docs.filter("doc_id is not null"), n, percent).collect()
    assert Counter(map(tuple, found)) == Counter((i, len(sets[i]), least[i]) for i, _ in kept)
    assert ngram_join.classes(empty, n, percent).count() == 0
    one = ngram_join.one_of_each(docs, n, percent)
    assert one.columns == docs.columns and Counter(r.doc_id for r in one.collect())[2] == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (3, 9), (9, 8), *((100 + k, 101 + k) for k in range(40)), (7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found[9] == found[8] == 1 and found[11] == 10 and found[5] == 4 and found[140] == 100
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    made = []
    for k in range(300):
        t = list(rng.choice(words, 40))
        if k % 4 == 0:
            t[int(rng.integers(0, 40))] = str(rng.choice(["nasty", "vile"]))
        made.append((k, " ".join(t), "en", int(k % 4 == 0)))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.filter("doc_id < 200").select("doc_id", "toxic"))
    found = toxicity.score(df, model).join(df, "doc_id").filter("doc_id >= 200").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in found]) >= 0.95
    assert {r.doc_id for r in toxicity.drop_toxic(df, model).filter("doc_id >= 200").collect()} == {r.doc_id for r in found if not r.over_threshold}
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores)
    none = toxicity.train(docs, df.limit(0).select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_language(spark, docs, empty):
    model = language.train(spark.createDataFrame([("the house and the garden of the town", "en"), ("das haus und der garten der stadt", "de")] * 3, "text string, lang string"), bpe.vocabulary("piece_bpe_32k.model"))
    asked = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(asked, model).orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und"]
    assert language.predict(docs, model).count() == len(TEXTS) and language.predict(empty, model).count() == 0
    nothing = language.train(empty, bpe.vocabulary("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    model = language.Model(["x"], ["a", "b", "ab", "aba"])
    model.p[1:, 0] = [0.1, 0.2, 0.3, 0.4]

    def total(w):
        return 1.0 if not w else sum(model.p[model.index[w[:k]], 0] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in model.index)

    for w in ("a", "ab", "abab", "ababa"):
        assert np.isclose(np.exp(model.log_likelihood([w])[0, 0]), total(w))


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a>News</a></li></ul></nav><article><h1>A title</h1><p>Some &amp; <b>bold</b>  text.<p>More\n text here, and more.</article><div class='comments'><p>I like it</p></div><footer>&copy; us</footer><script>var a = '<p>no</p>'</script>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page[:-30]), (5, "u", "<p"), (6, None, "<!-- <article><p>x")], "page_id long, url string, html string")
    found = {r.page_id: r for r in html_text.extract(pages.withColumn("text", F.lit(1))).collect()}
    assert found[1].text == "A title Some & bold text. More text here, and more." == found[4].text and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == found[5].text == found[6].text == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_labels_generated_pages():
    model, rng, right = html_text.trained(), np.random.default_rng(5), []
    for _ in range(60):
        page, truth = html_text.generated(rng)
        found, known = html_text.blocks(page), dict(reversed(truth))
        score = model.score([html_text.features(found)])[0]
        right += [(s >= 0.5) == known[t] for (t, _, _), s in zip(found, score, strict=True) if t in known]
    assert np.mean(right) > 0.95


def test_queries_on_small_tables(spark):
    from prismal.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    lang = QUERIES["op9_language"](spark, folder).toPandas().merge(docs, on="doc_id")
    assert (lang.lang_pred == lang.lang)[lang.held_out].mean() > 0.95
    tox = QUERIES["op6_toxicity"](spark, folder).toPandas().merge(labels, on="doc_id")
    assert len(tox) == len(labels) and tox.score.between(0, 1).all()


def test_ngram_join_links_through_a_null_id(spark):
    """A and C are linked only through B, whose id is null."""
    w = [f"w{k}" for k in range(100)]
    texts = [" ".join(w), " ".join(w[4:] + ["x1", "x2", "x3"]), " ".join(w[8:] + ["x1", "x2", "x3", "x4", "x5", "x6"])]
    df = spark.createDataFrame([(1, texts[0], "k"), (None, texts[1], "k"), (3, texts[2], "k")], "doc_id long, text string, key string")
    found = {r.doc_id: r.component_id for r in ngram_join.classes(df, 4, 85).collect()}
    assert found == {1: 1, None: 1, 3: 1}

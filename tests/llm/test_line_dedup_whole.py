"""The line operator against what it must not leave out: chains, every character, short lines, recall of the bands."""

import numpy as np

from prismal.llm import line_dedup


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(n)]


def changed(line, *at):
    return " ".join(w[:-1] + "0" if k in at else w for k, w in enumerate(line.split()))


def removed(spark, lines, **more):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r.n_removed for r in line_dedup.dedup(df, **more).orderBy("doc_id").collect()]


def test_a_chain_is_joined_whichever_line_is_tried_first(spark, monkeypatch):
    """u ~ v ~ w, u not near w, all in one bucket whose representative is u."""
    monkeypatch.setattr(line_dedup, "BANDS", ((),))
    rng = np.random.default_rng(3)
    while True:
        v = " ".join(words(rng, 40))
        u, w = changed(v, 10, 11), changed(v, 30, 31)
        h = spark.createDataFrame([(v,), (u,), (w,)], "t string").selectExpr("xxhash64(t) h").collect()
        if h[1].h == min(x.h for x in h):
            break
    assert removed(spark, [v, u, w]) == [0, 1, 1]


def test_shingles_start_at_every_character(spark):
    """Unspaced text that one character in front shifts is still a near copy."""
    text = "".join(chr(0x4E00 + int(k)) for k in np.random.default_rng(1).integers(0, 3000, 200)) + "🙂" + "字" * 20
    found = spark.createDataFrame([(text,)], "t string").select(line_dedup.shingles(line_dedup.F.col("t"), 12).alias("s")).first().s
    assert len(found) == len({text[k : k + 12] for k in range(len(text) - 11)})
    assert removed(spark, [text, "新" + text, text[:-1]]) == [0, 1, 1]


def test_signatures_are_the_minima_over_every_shingle(spark):
    lines = ["".join(np.random.default_rng(n).choice(list("abcé字🙂"), n)) for n in (12, 13, 43, 44, 45, 75, 76, 77, 500)]
    df = spark.createDataFrame(list(enumerate(lines)), "line long, norm string")
    got = {}
    for r in line_dedup.buckets(line_dedup.signatures(df, 12)).collect():
        got.setdefault(r.line, []).append(r.bucket)
    hashed = spark.createDataFrame([(k, t[i : i + 12]) for k, t in enumerate(lines) for i in range(len(t) - 11)], "line long, t string").selectExpr("line", "xxhash64(encode(t, 'UTF-32')) h").toPandas()
    rows = []
    for k, g in hashed.groupby("line"):
        low = [min((int(h) % 2**32) * m % 2**32 for h in g.h) - 2**31 for m in line_dedup.FACTORS]
        rows += [(k, b, *(low[i] for i in band)) for b, band in enumerate(line_dedup.BANDS)]
    want = spark.createDataFrame(rows, "line long, b int, x int, y int, z int").selectExpr("line", "b", "xxhash64(b, x, y, z) h").toPandas()
    assert got == {k: list(g.sort_values("b").h) for k, g in want.groupby("line")}


def test_the_query_and_the_pipeline_take_short_lines(spark, tmp_path):
    import corpus_pipeline
    from prismal.llm.queries import QUERIES

    tail = "a longer line of the second document that stays as it is"
    docs = spark.createDataFrame([(1, "Contents\nfourteen chars\n\n}"), (2, f"contents\nFourteen  chars\n\n}}\n\n{tail}"), (3, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert [(found[k].n_lines, found[k].n_removed) for k in (1, 2, 3)] == [(4, 0), (6, 3), (0, 0)]
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: "Contents\nfourteen chars\n\n}", 2: f"\n\n{tail}", 3: None}


def test_bands_find_pairs_at_the_threshold_however_few_their_shingles():
    rng, factors = np.random.default_rng(0), np.array(line_dedup.FACTORS, "u8")
    for shared, left, right in ((4, 1, 0), (8, 1, 1), (16, 2, 2), (80, 10, 10)):
        met = 0
        for _ in range(1500):
            h = rng.integers(0, 2**32, (shared + left + right, 1), dtype="u8") * factors & np.uint64(0xFFFFFFFF)
            same = h[: shared + left].min(0) == np.concatenate([h[:shared], h[shared + left :]]).min(0)
            met += any(same[list(b)].all() for b in line_dedup.BANDS)
        assert met / 1500 > 0.995


def test_repeated_rows_and_clashing_names(spark):
    """Rows that repeat id and text keep the same lines; columns that have the counts' names are replaced, others carried."""
    line = "a line that stands only in this one document of them all"
    df = spark.createDataFrame([(1, line, 5, "x"), (1, line, 5, "x"), (2, line, 6, "y")], "doc_id long, text string, n_removed int, _id string")
    found = sorted((r.doc_id, r.text, r.n_removed, r["_id"]) for r in line_dedup.dedup(df, min_chars=1).collect())
    assert found == [(1, line, 0, "x"), (1, line, 0, "x"), (2, "", 1, "y")]


def test_links_are_those_of_true_jaccard(spark):
    """Against all pairs of lines of one to three hundred characters, near copies at every distance."""
    rng = np.random.default_rng(11)
    lines = []
    for n in (3, 5, 8, 12, 20, 40, 50):
        for _ in range(6):
            base = " ".join(words(rng, n))
            lines.append(base)
            lines += [changed(base, *rng.choice(n, min(n, k), replace=False)) for k in (1, 1, 2, 3)]
    sets = [{x[k : k + 12] for k in range(len(x) - 11)} for x in lines]
    first = list(range(len(lines)))
    pairs = [(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in lines:
        for a, b in pairs:
            first[a] = first[b] = min(first[a], first[b])
    found = removed(spark, lines, min_chars=1)
    wrong = [k for k in range(len(lines)) if found[k] != int(first[k] != k)]
    assert len(pairs) > 60 and len(wrong) <= 1

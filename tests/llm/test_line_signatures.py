"""A row of the signature's aggregate takes sixteen shingles, and minima are those of all shingles whatever the length of a line."""

from pyspark.sql import functions as F

from prismal.llm import line_dedup


def test_minima_are_those_of_all_shingles(spark, monkeypatch):
    rows = [(n, "".join(chr(97 + (k * k * 7 + n) % 26) for k in range(n - 1)) + "é") for n in (12, 13, 27, 28, 29, 44, 60, 301)]
    lines = spark.createDataFrame(rows, "line long, norm string").coalesce(1)
    assert line_dedup.STEP == 16
    sizes = lines.select("line", F.explode(line_dedup.shingles(F.col("norm"), 12)).alias("x")).collect()
    got = {r.line: list(r)[1:] for r in line_dedup.signatures(lines, 12).collect()}
    for n, _ in rows:
        hashes = [r.x & line_dedup.LOW for r in sizes if r.line == n]
        assert got[n] == [min(h * m & line_dedup.LOW for h in hashes) - (1 << 31) for m in line_dedup.FACTORS]

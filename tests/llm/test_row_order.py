"""Token files and packing in any order of rows, and rows without an id."""

import random

from prismal.llm import bpe, packing, token_files

SCHEMA = "doc_id long, text string, source string, place string, named int"


def frames(spark):
    draw = random.Random(2)
    rows = [(None if k % 9 == 0 else k, " ".join(draw.choices(["one", "two", "three", "four"], k=draw.randrange(0, 90))), f"s{k % 3}", "x", 1) for k in range(150)]
    rows += [(3, "again", "s1", "x", 1)] * 3 + [(-1, "minus one", "s1", "x", 1), (8, None, None, "x", 1)]
    for parts in (1, 3, 7):
        draw.shuffle(rows)
        yield spark.createDataFrame(rows, SCHEMA).repartition(parts), rows


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    path, seen = bpe.vocabulary("byte_bpe_50k.json"), set()
    for df, rows in frames(spark):
        found = packing.pack(df, path, "byte", 1, length=64).collect()
        seen.add(tuple(sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.sequence_id, r.offset, str(r.source)) for r in found)))
        assert sum(r.doc_id is None and r.start == 0 for r in found) == sum(i is None for i, *_ in rows)
        assert sum(r.doc_id == -1 for r in found) >= 1
    assert len(seen) == 1


def test_token_files_keep_rows_without_an_id(spark):
    path, seen = bpe.vocabulary("word_bpe_49k.json"), set()
    for df, rows in frames(spark):
        found = token_files.read(token_files.write(df, path, "word", 1)).drop("shard").orderBy("start").collect()
        seen.add(tuple(map(tuple, found)))
        nulls = sum(i is None for i, *_ in rows)
        assert [r.doc_id is None for r in found] == [True] * nulls + [False] * (len(rows) - nulls)
    assert len(seen) == 1

"""Benchmark decontamination by a prefix-filtered set join.

A window is `width` consecutive item words (a shorter item is one window). Containment is whole, so the necessary
prefix of a window, its words ordered by rarity in the corpus, is its rarest word alone. Document words are joined with
those prefixes; a partner must leave room for the window (length bound) at the place where the word stands
in it (positional bound); then the words themselves are compared. DataFrame functions only. The corpus is read twice:
for the frequencies of the benchmark's words, and for the join. Both join against the benchmark side, which is
broadcast up to `broadcast_rows` rows of prefixes and dealt by word beyond that.

Defined results: a null text has no words; a document without words has a row with zero counts; repeated rows give
repeated rows; an empty benchmark gives zero counts throughout; other columns are ignored; an item that stands twice in the
benchmark counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import ascii_lower, fresh, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, window (words), of every item with words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, width).alias("window")).distinct()


def prefixes(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """(word, at, size, window, item_id): each window under its rarest word; whether that is small enough to broadcast."""
    wins = table(windows(benchmark, width), "windows")
    each = wins.select("item_id", "window", F.posexplode("window").alias("at", "word"))
    vocabulary = table(each.select("word").distinct(), "words")
    small = vocabulary.count() <= broadcast_rows and wins.count() <= broadcast_rows
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "word", "left").groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("at"))).alias("first"))
    found = ranked.filter("first.n > 0").select(F.col("first.word").alias("p_word"), F.col("first.at").alias("p_at"), F.size("window").alias("p_size"), F.col("window").alias("p_window"), "item_id")
    return table(found, "prefixes"), small


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_rows: int = 500_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_key, n_words, spans (start and end of every occurrence), items."""
    prefix, small = prefixes(docs, benchmark, width, broadcast_rows)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).select("doc_id", "text_key", "w", F.posexplode_outer("w").alias("pos", "word"))
    start = F.col("pos") - F.col("p_at")
    inside = (start >= 0) & (start + F.col("p_size") <= F.size("w"))
    verified = F.coalesce(inside & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("p_size")) == F.col("p_window")), F.lit(False))
    joined = rows.join(F.broadcast(prefix) if small else prefix, F.col("word") == F.col("p_word"), "left")
    # the first word of each row stays, so that a row without a hit has its result from the same pass
    kept = joined.select("doc_id", "text_key", F.size("w").alias("n_words"), "pos", start.alias("start"), (start + F.col("p_size")).alias("end"), "item_id", verified.alias("hit")).filter(F.col("hit") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return kept.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("hit"), F.struct("start", "end")))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("item_id"))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Positions inside sorted spans, each once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = hits(docs, benchmark, width)
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    one = found.select("doc_id", "text_key", F.col("n_words").cast("long"), covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "spans").withColumn("contaminated", F.col("n_hit") > 0)
    copies = docs.select("doc_id", F.xxhash64("text").alias("text_key")).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    more = one.alias("o").join(copies.alias("c"), F.col("o.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("o.text_key") == F.col("c.text_key")), "left")
    return more.select("o.*", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))).alias("_copy")).drop("_copy", "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs, all their columns, that hold no window of the benchmark."""
    d, k = fresh(docs, "_id", "_key")
    bad = hits(docs, benchmark, width).filter(F.size("items") > 0).select(F.col("doc_id").alias(d), F.col("text_key").alias(k))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left_anti")

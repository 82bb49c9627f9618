"""Quality rules: base counts of a document, and cross-document line frequency within its host.

Lines are normalised (blanks collapsed, digits runs as 0, lower case) and hashed; for every host the distinct documents
that hold a line are counted, copies of one text as one document. A line in over `max_share` of its host's distinct
documents, and in over `min_docs`, is taken out; a document that loses over half its words that way is depleted and
rejected. DataFrame functions only. Counting is by (host, line, text) first, so a line that a third of all rows
holds is summed before it is dealt.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows
each get their row, with the same verdict; an empty table gives no row; other columns are ignored. Windows are
compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import fresh, let, table

BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEAT_PERCENT = 50, 50
MAX_SHARE, MIN_DOCS = 0.05, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows may overlap."""
    empty = F.array().cast("array<bigint>")
    hashes = F.when(F.size(ws) >= 3, F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))).otherwise(empty)

    def covered(found: Column) -> Column:
        step = lambda x, k: F.when(k == F.size(found) - 1, F.lit(3)).otherwise(F.least(F.lit(3), found[k + 1] - x))
        return F.aggregate(F.transform(found, step), F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda x, k: ((k > 0) & (pairs[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(pairs) - 1) & (pairs[F.least(k + 1, F.size(pairs) - 1)]["h"] == x["h"]))
        return let(F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, twice))

    return let(hashes, count)


def base(df: DataFrame) -> DataFrame:
    """doc_id, text_key and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = df.select("doc_id", F.xxhash64("text").alias("text_key"), text.alias("_t"), words(F.col("text")).alias("_w"), lines.alias("_l")).select(
        "doc_id",
        "text_key",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), repeated_words).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, BLANKS, " "), "[0-9]+", "0")))


def frequent_lines(df: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines of all documents: doc_id, text_key, host, pos, line, n_words; (host, line) pairs above the limits)."""
    source = df.select("doc_id", F.xxhash64("text").alias("text_key"), F.col(host).alias("host"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    n = F.size(words(F.col("raw"))).cast("long")
    lines = table(source.select("doc_id", "text_key", "host", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"), n.alias("n_words")), "lines")
    docs = lines.filter("pos = 0").select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = lines.filter("n_words > 0").select("host", "line", "text_key").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    both = seen.alias("s").join(docs.alias("d"), F.col("s.host").eqNullSafe(F.col("d.host")))
    return lines, both.filter(F.col("docs") > max_share * F.col("host_docs")).select("s.host", "line", "docs")


def verdicts(df: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: base counts, base_failed, kept, removed_words and removed_lines (positions of the lines taken out)."""
    lines, frequent = frequent_lines(df, host, max_share, min_docs)
    hit = lines.alias("a").join(frequent.alias("b"), (F.col("a.line") == F.col("b.line")) & F.col("a.host").eqNullSafe(F.col("b.host")), "left_semi")
    # rows repeated with their text would be summed together; each such copy holds each position once
    per_line = hit.groupBy("doc_id", "text_key", "pos").agg(F.max("n_words").alias("n"))
    removed = per_line.groupBy("doc_id", "text_key").agg(F.sum("n").alias("removed_words"), F.sort_array(F.collect_list("pos")).alias("removed_lines"))
    out = base(df).alias("d").join(removed.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key")), "left")
    lost = F.coalesce("removed_words", F.lit(0))
    return out.select("d.*", lost.alias("removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines")).withColumn("kept", ~F.col("base_failed") & (2 * F.col("removed_words") <= F.col("n_words")))


def clean(df: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows that are kept, all their columns, their texts without the lines above the limits."""
    d, k, g = fresh(df, "_id", "_key", "_gone")
    found = verdicts(df, host, max_share, min_docs).filter("kept").select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("removed_lines").alias(g)).distinct()
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(g), i)), "\n")
    joined = df.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)))
    return joined.withColumn("text", F.when(F.size(g) > 0, text).otherwise(F.col("text"))).select(*df.columns)

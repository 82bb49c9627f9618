"""A corpus pipeline of five stages over `documents`; each stage works on what the one before it wrote.

Every stage carries columns of any name, null texts and ids, and takes an empty table. Stages: documents above the toxicity threshold of their language go; lines that repeat or nearly repeat elsewhere go, with
documents that keep under a fifth of their characters; one document of each near-duplicate group stays; documents that hold
a benchmark window go; the rest is packed. SQL can't express the first stage (a trained classifier) nor the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import bpe, decontaminate, line_dedup, ngram_join, packing, toxicity
from prismal.llm.common import fresh, give_back, load, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document must keep this share of its characters in the line stage.
KEPT = 0.2


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over the threshold of their language go. A null or empty text is scored as an empty one; a null language takes the
    common threshold; repeated rows are judged alike; with no labels, or labels of one kind, none goes."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    give_back()
    return toxicity.drop_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or nearly equal lines one stays; documents that keep under a fifth of their characters go. Null and empty texts stay
    as they are; rows that repeat an id and a text keep the same lines; n_chars follows the text where it is a column."""
    before, n, gone = fresh(docs, "_before", "_lines", "_removed")
    found = line_dedup.dedup(docs.withColumn(before, F.coalesce(F.length("text"), F.lit(0))), min_chars=1, n_lines=n, n_removed=gone)
    kept = found.filter((F.col(gone) == 0) | (F.length("text") >= KEPT * F.col(before)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each near-duplicate group stays. Texts without words, null ones too, are in no group and stay; rows that share an id and
    a text become one; rows without an id stay."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. A text without words holds none; with an empty benchmark all stay."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left. A null text packs its end id; a null source is a queue, a null id stays null; an empty table gives no row."""
    return packing.pack(docs, bpe.vocabulary("byte_bpe_50k.json"), "byte", end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

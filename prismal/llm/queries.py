"""The queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import bpe, conversation_trie, decontaminate, html_text, language, line_dedup, line_quality, merkle, ngram_join, packing, simhash, substring_dedup, token_files, toxicity
from prismal.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(load(spark, sf_dir, "documents"), bpe.vocabulary("word_bpe_49k.json"), "word", end_id=1)
    return token_files.read(manifest)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.verdicts(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    kept = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept, 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(load(spark, sf_dir, "documents"), size=400).drop("spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.train(docs, load(spark, sf_dir, "labels").filter(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = language.train(docs.filter(~held_out), bpe.vocabulary("piece_bpe_32k.model"))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"), "byte", end_id=1)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(load(spark, sf_dir, "documents"), n=4, percent=85)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered(load(spark, sf_dir, "conversations"))
    return conversation_trie.trie(turns, conversation_trie.branched(turns))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(load(spark, sf_dir, "documents"), merkle.leaf(merkle.FIELDS, n_chars=longer))
    return found.withColumnRenamed("id", "doc_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_files, op2_html_text, op3_line_quality, op4_line_dedup, op5_substring_dedup, op6_toxicity, op7_decontamination, op8_packing, op9_language, op10_ngram_join, op11_conversation_trie, op12_merkle_manifest, op13_simhash)}

"""Validation: ordered rules to one of four verdicts, confusion counts, and what kind of mutation a copy is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts, as the validator names them.
VALID, CORRUPT, UNSUPPORTED, INDETERMINATE = "valid", "corrupt", "unsupported", "indeterminate"


def first_finding(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Adds verdict and code of the first rule (condition, verdict, code) that holds; no rule: valid. Limits go before corruption."""
    pick = lambda at, otherwise: reduce(lambda c, r: c.when(r[0], r[at]), rules, F).otherwise(otherwise)
    return df.withColumn("verdict", pick(1, VALID)).withColumn("code", pick(2, "none"))


def classify(exit_code: Column, verdict: Column, signal: Column) -> Column:
    """Outcome of a validator process."""
    return F.when(signal > 0, "operational_failure").when(exit_code == 2, "resource_failure").when(verdict == VALID, F.when(exit_code == 0, VALID).otherwise("operational_failure")).when(verdict.isin(CORRUPT, UNSUPPORTED, INDETERMINATE), verdict).otherwise("operational_failure")


def matrix(df: DataFrame, kind: str, verdict: str) -> DataFrame:
    counts = [F.count_if(F.col(verdict) == v).alias("n_" + v) for v in (VALID, CORRUPT, UNSUPPORTED, INDETERMINATE)]
    return df.groupBy(kind).agg(*counts, F.count("*").alias("n"))


def mutation(pairs: DataFrame, base: str, mutant: str) -> DataFrame:
    """Of texts aligned by position: how many code points differ, first and last such position, and the kind of change.

    Both sides are compared in place, element by element of the shorter; a shorter mutant is a truncation.
    """
    a, b = F.split(base, ""), F.split(mutant, "")
    differs = F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z: z)
    where = F.filter(F.transform(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z, i: F.when(z, i)), lambda i: i.isNotNull())
    kind = F.when(F.col("n_diff") == 0, "same").when((F.length(mutant) < F.length(base)) & F.col(base).startswith(F.col(mutant)), "truncate").when(F.col("n_diff") == 1, "flip").when(F.col("last_diff") - F.col("first_diff") + 1 == F.col("n_diff"), "burst").otherwise("scatter")
    found = pairs.withColumn("n_diff", F.size(differs).cast("long")).withColumn("_w", where)
    return found.withColumn("first_diff", F.array_min("_w").cast("long")).withColumn("last_diff", F.array_max("_w").cast("long")).drop("_w").withColumn("kind", kind)


def discriminating(found: DataFrame, bases: DataFrame, base: str) -> DataFrame:
    """Rejections that count: those whose clean base is accepted."""
    return found.join(bases, base, "left_semi")


def duplicated_fields(df: DataFrame, record: str, field: str) -> DataFrame:
    """Fields that a record reports more than once: such a report is malformed."""
    return df.groupBy(record, field).agg(F.count("*").alias("n")).filter("n > 1")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")

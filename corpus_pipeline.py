"""A training-corpus pipeline over ``documents``: five operators of the llm subpackage, each on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import materialise, table
from ledgerweave.llm.exact_dedup import exact_dedup
from ledgerweave.llm.ngram_join import ngram_join
from ledgerweave.llm.packing import pack, word_lengths
from ledgerweave.llm.suffix_dedup import suffix_dedup
from ledgerweave.llm.toxicity import clean

#: several stages decide by similarity over whole corpora; tested against brute force on small fixtures instead
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: bytes of a repeated passage: about fifty words of five letters, shorter than what op8_suffix_dedup's contract fixes
PASSAGE = 256


def _own(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame], nulls_first: bool) -> DataFrame:
    """Rows of ``docs`` that ``decide(rows, id column)`` returns, each by its own decision.

    If an id is null or repeated, rows are told apart by numbers in the order of their ids instead.
    """
    docs, at = docs.select(*COLUMNS), "doc_id"
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        by = F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id")
        ordered = docs.withColumn("row", F.monotonically_increasing_id()).orderBy(by, "row")
        docs, at = materialise(ordered.withColumn("row", F.monotonically_increasing_id()), "rows"), "row"
    return docs.join(decide(docs, at).select(at), at, "left_semi").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays, one of those that repeat it; null is the least."""
    return _own(docs, lambda rows, at: exact_dedup(rows, at).where("kept"), True)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the row of the smallest doc_id stays, one of those that repeat it; null is the last."""
    return _own(docs, lambda rows, at: ngram_join(rows, at).where(F.col(at) == F.col("component_id")), False)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` bytes or more that repeat are cut out wherever they stand; a character that a cut splits becomes U+FFFD. Every document stays, if empty."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    cut = suffix_dedup(docs, length=PASSAGE, carry=("lang", "source")).withColumn("text", text)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, by white-space words."""
    return pack(word_lengths(docs))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("ngram_join", ngram_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

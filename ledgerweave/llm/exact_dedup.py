"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Misra-Gries summaries (Spark's frequent-items aggregate, the Karp-Shenker-Papadimitriou form) name every digest that
could hold more than ``support`` of the rows, at most 1/support of them. Their exact counts and winners are verified in
one aggregation and broadcast - a table of at most 1/support rows - so copies of hot texts are settled on the map side.
All other digests, none of which can be hot, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the unchanged text in UTF-8 as 32 bytes; null counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id stays. Rows that repeat an id and its text are one document told twice: each such row
    is answered, with the same decision, and each counts in group_size. A null id never beats another id; a group of
    null ids only has a null keep_id and keeps its rows. Other columns of ``docs``, whatever their names, are not read.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    frequent = rows.stat.freqItems(["digest"], support).first()[0] or []
    best = (F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    spark = docs.sparkSession
    # at most 1/support digests of 32 bytes, whatever the input
    named = spark.createDataFrame([(bytes(x),) for x in frequent], "digest binary").distinct()
    heavy = rows.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(*best)
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(named), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*best).where("group_size > 1")
    cold = rest.join(groups, "digest", "left").select("digest", "id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return hot.select(cold.columns).unionByName(cold).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""

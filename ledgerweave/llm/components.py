"""Distributed connected components in DataFrame operations only: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one orderable type); component = smallest node.

    Each round attaches neighbours to the smallest node known around them, so paths shorten by a constant factor;
    rows with a null end and self loops are ignored, repeated edges count once. Hubs are handled by min-aggregation
    (partial before the shuffle) and a join AQE may split; nothing is gathered in a task or on the driver.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = None
    now = materialise(pairs.where("u <> v").distinct(), "cc")
    seen = _mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low2, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(low2.select("u", F.col("w").alias("v")))
        before, now = now, materialise(small.distinct(), "cc")
        release(before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

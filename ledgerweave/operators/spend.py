"""Exact spend per currency and its leaders (E-1..E-4, W-3, J-2, J-3, P-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def totals(spend: DataFrame, *keys: str) -> DataFrame:
    """Sum and count per key; currencies are never added up with each other."""
    return spend.groupBy(*keys, "currency").agg(F.sum("amount").cast(MONEY).alias("total"), F.count(F.lit(1)).alias("n_lines"))


def by_entity(spend: DataFrame, members: DataFrame) -> DataFrame:
    """E-2: per supplier first, so the join with the membership moves one row a supplier and currency."""
    per = totals(spend, "supplier_id")
    joined = per.join(members.select("supplier_id", "entity_id"), "supplier_id")
    return joined.groupBy("entity_id", "currency").agg(F.sum("total").cast(MONEY).alias("total"), F.sum("n_lines").alias("n_lines"))


def leaders(per_entity: DataFrame) -> DataFrame:
    """W-3: the entity with the largest total of each currency, the smaller id where equal; one without a total only where no entity has one."""
    first = F.min(F.struct(F.col("total").isNull(), F.negative("total"), "total", "entity_id")).alias("first")
    return per_entity.groupBy("currency").agg(first).select("currency", "first.total", "first.entity_id")


def scoped(spend: DataFrame, suppliers: list[str] | None = None, currencies: list[str] | None = None) -> DataFrame:
    """P-11: lines of some suppliers and currencies; None means all."""
    out = spend if suppliers is None else spend.where(F.col("supplier_id").isin(suppliers))
    return out if currencies is None else out.where(F.col("currency").isin(currencies))


def repeated_references(spend: DataFrame, order: str) -> DataFrame:
    """W-11: lines whose invoice id came before, in the given order."""
    n = F.row_number().over(Window.partitionBy("invoice_id").orderBy(order))
    return spend.withColumn("n", n).where("n > 1").drop("n")

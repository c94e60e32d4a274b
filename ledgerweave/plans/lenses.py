"""Canonical supplier and spend views over the TPC-H-like tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUPPLIERS = """
SELECT 'SUP-' || lpad(CAST(s_suppkey AS {text}), 6, '0') AS supplier_id,
  p_name || CASE s_suppkey % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Limited' WHEN 2 THEN ' GmbH' ELSE '' END AS name,
  CASE n_regionkey WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'ZZ' END AS country,
  CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 11 = 0 THEN '000000' ELSE 'REG-' || CAST(s_suppkey % {regs} AS {text}) END AS registration_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'VAT' || CAST(s_suppkey % {taxes} AS {text}) ELSE '' END AS tax_id,
  'PC' || CAST(s_nationkey AS {text}) || ' ' || CAST(s_suppkey % 7 AS {text}) AS postcode,
  CAST(s_suppkey % 9 + 1 AS {text}) || ' ' || p_type || ' street' AS address,
  CASE WHEN s_suppkey % 6 = 1 THEN 'LEI' || CAST(s_suppkey % 17 AS {text}) ELSE '' END AS lei,
  CASE WHEN s_suppkey % 6 = 2 THEN 'LEI' || CAST(s_suppkey % 17 AS {text}) ELSE '' END AS parent_lei
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = s_suppkey
"""
SPEND = """
SELECT 'I-' || CAST(l_orderkey AS {text}) || '-' || CAST(l_linenumber AS {text}) || '-' || CAST(l_partkey AS {text}) || '-' || CAST(l_suppkey AS {text}) AS invoice_id,
  'SUP-' || lpad(CAST(l_suppkey AS {text}), 6, '0') AS supplier_id, CAST(l_shipdate AS DATE) AS invoice_date,
  CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(14,2)) AS DECIMAL(14,2)) AS amount,
  CASE (l_suppkey + l_linenumber) % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, l_returnflag AS category
FROM lineitem
"""
#: a registration is shared by a few of about a hundred suppliers; larger tables take the next moduli
REGS, TAXES = 30, 7


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def suppliers(spark: SparkSession, sf_dir: str, regs: int = REGS, taxes: int = TAXES) -> DataFrame:
    views(spark, sf_dir, "supplier", "nation", "part")
    return spark.sql(SUPPLIERS.format(text="STRING", regs=regs, taxes=taxes))


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(SPEND.format(text="STRING"))


def with_sql(body: str, regs: int = REGS, taxes: int = TAXES) -> str:
    """DuckDB SQL with the lenses in front, as s and v."""
    parts = [f"s AS ({SUPPLIERS.format(text='VARCHAR', regs=regs, taxes=taxes)})", f"v AS ({SPEND.format(text='VARCHAR')})"]
    body = body.strip()
    head = "WITH RECURSIVE " if body.startswith("RECURSIVE") else "WITH "
    body = body.removeprefix("RECURSIVE").strip()
    return head + ", ".join(parts) + (", " + body.removeprefix("WITH ") if body.startswith("WITH ") else " " + body)

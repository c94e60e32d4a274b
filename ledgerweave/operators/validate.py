"""Constraints as violation queries that must return no rows (P-2..P-10, P-15..P-20, J-1, J-22, J-24, E-8, E-24, E-32, W-12, L-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.values import valid_date


class DatasetRefused(ValueError):
    """A dataset violates a constraint and is not accepted."""


def staged_suppliers(raw: DataFrame) -> DataFrame:
    """P-15: trimmed and upper-cased canonical columns."""
    return raw.select(F.trim("supplier_id").alias("supplier_id"), F.trim("name").alias("name"), F.upper(F.trim("country")).alias("country"), S.identifier("registration_id").alias("registration_id"), S.identifier("tax_id").alias("tax_id"), F.upper(F.regexp_replace("postcode", r"\s", "")).alias("postcode"))


def staged_spend(raw: DataFrame) -> DataFrame:
    """P-16: canonical text of every spend column, before typing."""
    return raw.select(F.trim("invoice_id").alias("invoice_id"), F.trim("supplier_id").alias("supplier_id"), F.trim(F.col("invoice_date").cast("string")).alias("invoice_date"), F.trim(F.col("amount").cast("string")).alias("amount"), F.upper(F.trim("currency")).alias("currency"))


def invalid_suppliers(s: DataFrame) -> DataFrame:
    """P-2, P-3, P-17, P-8, P-9."""
    bad = (F.trim("supplier_id") == "") | (F.trim("name") == "") | ~F.upper(F.trim("country")).rlike("^[A-Z]{2}$")
    if "lei" in s.columns:
        bad = bad | ((S.identifier("lei") != "") & ~S.valid_lei(S.identifier("lei")))
    if "bank_account_hash" in s.columns:
        bad = bad | ((F.col("bank_account_hash") != "") & ~F.col("bank_account_hash").rlike("^[0-9a-f]{64}$"))
    return s.where(F.coalesce(bad, F.lit(True)))


def invalid_spend(v: DataFrame) -> DataFrame:
    """P-4, P-5, P-6, P-18 over staged text."""
    ok = valid_date("invoice_date") & F.col("amount").rlike(r"^-?[0-9]{1,12}(\.[0-9]{1,2})?$") & F.col("currency").rlike("^[A-Z]{3}$") & (F.col("invoice_id") != "")
    return v.where(~F.coalesce(ok, F.lit(False)))


def orphans(v: DataFrame, s: DataFrame) -> DataFrame:
    """J-1, J-24: lines whose supplier is unknown."""
    return v.join(s.select("supplier_id").distinct(), "supplier_id", "left_anti")


def exact_duplicates(v: DataFrame, key: str = "invoice_id") -> DataFrame:
    """E-32: keys told more than once in the same words, and how often."""
    rest = [c for c in v.columns if c != key]
    return v.groupBy(key, F.xxhash64(*rest).alias("row_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "n")


def conflicting(v: DataFrame, key: str, *cols: str) -> DataFrame:
    """P-19, E-24, W-12: keys that stand for different rows; copies shrink to one before they are counted."""
    return v.select(key, *cols).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def not_unique(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_sets_differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J-22, O-12: keys on one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def _claims(s: DataFrame) -> dict[str, Column]:
    return {"registration_id": S.authority("registration_id"), "lei": S.identifier("lei") if "lei" in s.columns else F.lit("")}


#: P-10: records of a country that may share an identifier before it counts as reused
REUSED = 25


def reused_authority(s: DataFrame, limit: int = REUSED) -> DataFrame:
    """P-10, E-8: (country, field, value) that more than ``limit`` records claim."""
    claimed = [F.struct(F.lit(f).alias("field"), value.alias("value")) for f, value in _claims(s).items()]
    fields = F.explode(F.array(*claimed)).alias("f")
    return s.select("country", fields).where("f.value <> ''").groupBy("country", "f.field", "f.value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def blank_reused(s: DataFrame, limit: int | None = REUSED) -> DataFrame:
    """P-10: registrations and LEIs that too many records of a country share no longer identify: they become ''. None: all stay."""
    if limit is None:
        return s
    hot, out = reused_authority(s, limit), s
    for field, value in _claims(s).items():
        if field in s.columns:
            own = hot.where(F.col("field") == field).select(F.col("country").alias("_c"), F.col("value").alias("_hot"))
            joined = out.withColumn("_v", value).join(own, (F.col("country") == F.col("_c")) & (F.col("_v") == F.col("_hot")), "left")
            out = joined.withColumn(field, F.when(F.col("_hot").isNull(), F.col(field)).otherwise("")).drop("_v", "_c", "_hot")
    return out


def accept(suppliers: DataFrame, spend: DataFrame) -> DataFrame:
    """K-1's gate: the spend lines without exact duplicates, or DatasetRefused naming the first broken constraint."""
    for name, rows in (
        ("invalid suppliers", invalid_suppliers(suppliers)), ("repeated supplier ids", not_unique(suppliers, "supplier_id")), ("invalid spend", invalid_spend(staged_spend(spend))),
        ("orphan invoices", orphans(spend, suppliers)), ("conflicting invoices", conflicting(spend, "invoice_id", *[c for c in spend.columns if c != "invoice_id"])),
    ):
        if not rows.isEmpty():
            raise DatasetRefused(name)
    return spend.distinct()

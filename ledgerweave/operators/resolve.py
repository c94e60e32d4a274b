"""Conservative identity groups (R-1..R-12): two grouped passes instead of union-find.

A group is kept when it is a clique: one country, at most one registration, tax id, LEI and bank hash, no member's LEI
another's parent, and one key all members share. Pass 1 groups by (country, registration); pass 2 takes, for each
(country, LEI), the pass-1 groups that it touches. A valid pass-1 group has at most one LEI, so closures are disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S
from .validate import REUSED, blank_reused

FIELDS = ("registration_id", "tax_id", "lei", "bank_account_hash", "parent_lei")


def prepared(s: DataFrame) -> DataFrame:
    """Identifiers as they count for identity; missing optional columns are ''."""
    s = s.withColumns({f: F.lit("") for f in FIELDS if f not in s.columns})
    return s.select("supplier_id", "name", "country", *[(S.authority if f in ("registration_id", "tax_id") else S.identifier)(f).alias(f) for f in FIELDS])


def _valid() -> list[Column]:
    told = lambda f: F.collect_set(F.when(F.col(f) != "", F.col(f)))
    one = [F.size(told(f)) <= 1 for f in ("tax_id", "bank_account_hash")]
    shares = ((F.min(F.col("registration_id") != "")) & (F.size(told("registration_id")) == 1)) | (F.min(F.col("lei") != "") & (F.size(told("lei")) == 1))
    ok = (F.min("country") == F.max("country")) & one[0] & one[1] & (F.size(told("registration_id")) <= 1) & (F.size(told("lei")) <= 1) & ~F.arrays_overlap(told("lei"), told("parent_lei")) & shares
    return [ok.alias("ok"), F.count(F.lit(1)).alias("n"), F.min("supplier_id").alias("root")]


def memberships(s: DataFrame, limit: int | None = REUSED) -> DataFrame:
    """R-7, R-8, P-10: (supplier_id, root, entity_id) for every supplier id; root is the group's smallest id.

    Records that repeat an id are one supplier, in the group of its smallest root. A registration or LEI that more than ``limit`` records of a country share identifies nobody; None: every one identifies.
    """
    rows = prepared(blank_reused(s, limit))
    pass1 = rows.where("registration_id <> ''").groupBy("country", "registration_id").agg(*_valid()).where("ok and n > 1").select("country", "registration_id", F.col("root").alias("r1"))
    one = rows.join(pass1, ["country", "registration_id"], "left").withColumn("g1", F.coalesce("r1", "supplier_id")).drop("r1")
    touched = one.where("lei <> ''").select(F.col("country").alias("c2"), F.col("lei").alias("l2"), "g1").distinct()
    closures = one.join(touched, "g1").groupBy("c2", "l2").agg(*_valid(), F.collect_set("g1").alias("groups")).where("ok and n > 1 and size(groups) > 1")
    pass2 = closures.select(F.explode("groups").alias("g1"), F.col("root").alias("r2"))
    two = one.join(pass2, "g1", "left").groupBy("supplier_id").agg(F.coalesce(F.min("r2"), F.min("g1")).alias("root"))  # records of one id are one supplier
    ids = two.groupBy("root").agg(F.array_sort(F.collect_list("supplier_id")).alias("ids"))
    named = ids.select("root", F.concat(F.lit("entity-"), F.substring(F.sha2(F.array_join("ids", "\0"), 256), 1, 12)).alias("entity_id"))
    return two.join(named, "root")


def entities(s: DataFrame, members: DataFrame) -> DataFrame:
    """R-9: one row per entity: display name and country of its smallest id, member ids, sorted distinct identifiers."""
    told = lambda f: F.array_join(F.array_sort(F.collect_set(F.when(F.col(f) != "", F.col(f)))), "|")
    rows = prepared(s).join(members, "supplier_id")
    return rows.groupBy("entity_id").agg(
        F.min_by("name", "supplier_id").alias("display_name"), F.min_by("country", "supplier_id").alias("country"), F.array_join(F.array_sort(F.collect_list("supplier_id")), "|").alias("members"),
        F.count(F.lit(1)).alias("n_members"), told("registration_id").alias("registration_ids"), told("lei").alias("leis"), told("tax_id").alias("tax_ids"),
    )


def cluster_conflicts(s: DataFrame) -> DataFrame:
    """R-10: (country, registration) buckets that are no clique, and how many records and tax ids they hold."""
    rows = prepared(s).where("registration_id <> ''")
    return rows.groupBy("country", "registration_id").agg(*_valid(), F.size(F.collect_set(F.when(F.col("tax_id") != "", F.col("tax_id")))).alias("n_tax_ids")).where("not ok and n > 1").select("country", "registration_id", "n", F.col("n_tax_ids").cast("long").alias("n_tax_ids"))


def cluster_reviews(s: DataFrame, members: DataFrame) -> DataFrame:
    """R-10: neighbours by id in a (country, registration) bucket that is no clique, unless one entity holds both already."""
    rows = prepared(s).where("registration_id <> ''").join(members.select("supplier_id", "root"), "supplier_id")
    broken = cluster_conflicts(s).select("country", "registration_id")
    w = Window.partitionBy("country", "registration_id").orderBy("supplier_id")
    pairs = rows.join(broken, ["country", "registration_id"]).select(F.col("supplier_id").alias("left_id"), F.lead("supplier_id").over(w).alias("right_id"), "root", F.lead("root").over(w).alias("root2"))
    return pairs.where("right_id is not null and root <> root2").select("left_id", "right_id")


def shared_tax_reviews(s: DataFrame, members: DataFrame) -> DataFrame:
    """R-11, W-7: neighbours by id that share a tax id in a country but not an entity."""
    rows = prepared(s).where("tax_id <> ''").join(members.select("supplier_id", "root"), "supplier_id")
    w = Window.partitionBy("country", "tax_id").orderBy("supplier_id")
    pairs = rows.select("country", "tax_id", F.col("supplier_id").alias("left_id"), F.lead("supplier_id").over(w).alias("right_id"), "root", F.lead("root").over(w).alias("root2"))
    return pairs.where("right_id is not null and root <> root2").select("country", "tax_id", "left_id", "right_id")


def conflict_reasons(a: str = "l", b: str = "r") -> Column:
    """R-2: ordered reasons why two prepared records, as structs, can't be one entity."""
    x, y = (lambda f, t=t: F.col(f"{t}.{f}") for t in (a, b))
    differ = [F.when((x(f) != "") & (y(f) != "") & (x(f) != y(f)), f + "_disagreement") for f in FIELDS[:4]]
    family = ((x("lei") != "") & (x("lei") == y("parent_lei"))) | ((y("lei") != "") & (y("lei") == x("parent_lei")))
    return F.array_compact(F.array(F.when(~x("country").eqNullSafe(y("country")), "country_disagreement"), *differ, F.when(family, "parent_child_relationship")))


def direct_identity(a: str = "l", b: str = "r") -> Column:
    """R-3: the legal keys two prepared records share."""
    return F.array_compact(F.array(*[F.when((F.col(f"{a}.{f}") != "") & (F.col(f"{a}.{f}") == F.col(f"{b}.{f}")), f) for f in ("registration_id", "lei")]))

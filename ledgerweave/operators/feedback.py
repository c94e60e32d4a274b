"""Reviewed pairs as training data (X-10, J-14..J-16, J-19, J-29, G-8, G-9, E-21, E-25, L-9).

Rows carry ``seq``, the order of decisions in the whole ledger. Record and pair keys are digests of contents, so an
edited record is another record, while source keys stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from . import model

DEFINITE = ("Match", "NonMatch")


class LabelsRefused(ValueError):
    """Labels that contradict each other or would let a group stand in two splits."""


def record_key(fields: tuple[str, ...], side: str) -> Column:
    """Digest of a record's fields, null as ''."""
    return S.fingerprint(*[F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit("")).alias(f) for f in sorted(fields)])


def feedback(decisions: DataFrame, evaluations: DataFrame, runs: DataFrame, s: DataFrame, namespace: str = "local") -> DataFrame:
    """X-10, J-16: one training row per decision, built from its evaluation, the run's configuration and both records.

    ``decisions`` is (decision_id, evaluation_id, human_label, seq, ...), ``evaluations`` (evaluation_id, run_id, left_id,
    right_id, ... features), ``runs`` (run_id, config_id, ...). Decisions on unknown evaluations give no row.
    """
    fields = tuple(s.columns)
    rows = decisions.join(evaluations, "evaluation_id").join(runs, "run_id")
    for side, at in (("_l", "left_id"), ("_r", "right_id")):
        rows = rows.join(s.select(F.col("supplier_id").alias(at), F.struct(*fields).alias(side)), at)
        source = S.fingerprint(F.lit(namespace).alias("namespace"), F.col(at).alias("supplier_id"))
        rows = rows.withColumn("left_key" if side == "_l" else "right_key", record_key(fields, side)).withColumn("left_source" if side == "_l" else "right_source", source)
    pair = F.sha2(F.concat_ws("\n", F.least("left_key", "right_key"), F.greatest("left_key", "right_key")), 256)
    return rows.drop("_l", "_r").withColumn("pair_key", pair).withColumn("namespace", F.lit(namespace))


def missing(decisions: DataFrame, known: DataFrame, key: str = "decision_id") -> DataFrame:
    """J-15: the decisions that have no feedback yet."""
    return decisions.join(known.select(key), key, "left_anti")


def with_evaluation(reviews: DataFrame, evaluations: DataFrame) -> DataFrame:
    """J-19: review pairs with the id of their evaluation, null where there is none."""
    return reviews.join(evaluations.select("left_id", "right_id", "evaluation_id"), ["left_id", "right_id"], "left")


def pair_states(rows: DataFrame) -> DataFrame:
    """J-14, E-25: one row a pair: the newest decision of each evaluation counts; state is eligible, unsure or conflicting.

    A pair whose newest decision is Unsure is unsure, whatever came before; one with both definite labels conflicts.
    """
    rest = [c for c in rows.columns if c != "evaluation_id"]
    newest = rows.groupBy("evaluation_id").agg(F.max_by(F.struct(*rest), "seq").alias("d")).select("evaluation_id", "d.*")
    rest = [c for c in newest.columns if c != "pair_key"]
    kinds = F.count_distinct(F.when(F.col("human_label").isin(*DEFINITE), F.col("human_label")))
    per = newest.groupBy("pair_key").agg(F.max_by(F.struct(*rest), "seq").alias("d"), kinds.alias("kinds"))
    state = F.when(F.col("human_label") == "Unsure", "unsure").when(F.col("kinds") > 1, "conflicting").otherwise("eligible")
    return per.select("pair_key", "d.*", "kinds").withColumn("state", state).drop("kinds")


def statistics(rows: DataFrame) -> DataFrame:
    """E-21: events and how many pairs are in each state, one row."""
    pairs = pair_states(rows).agg(*[F.count_if(F.col("state") == k).alias(f"{k}_pairs") for k in ("eligible", "unsure", "conflicting")])
    return rows.agg(F.count(F.lit(1)).alias("review_events")).crossJoin(pairs)  # one row each


def assignments(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """G-8, G-9: (source, root, split) of every source key; sources joined by Match pairs share a split.

    ``known`` (source, split) are earlier assignments, which stay. A Match that links two known splits and a NonMatch
    inside a component are refused. A new component's split is drawn from its smallest key.
    """
    model.checkpointed(pairs.sparkSession)
    ends = pairs.select(F.col("left_source").alias("a"), F.col("right_source").alias("b"), "human_label").checkpoint()
    roots = model.label_components(ends.where("human_label = 'Match' and a <> b").select("a", "b"))
    every = ends.select(F.col("a").alias("source")).union(ends.select("b")).distinct()
    owned = every.join(roots.withColumnRenamed("node", "source"), "source", "left").withColumn("root", F.coalesce("root", "source")).checkpoint()
    side = lambda k: owned.select(F.col("source").alias(k), F.col("root").alias(k + "_root"))
    against = ends.where("human_label = 'NonMatch'").join(side("a"), "a").join(side("b"), "b").where("a_root = b_root")
    if not against.isEmpty():
        raise LabelsRefused("a NonMatch lies inside a component of Match pairs")
    if known is None:
        return owned.withColumn("split", model.bucket_split(F.col("root")))
    told = owned.join(known.select("source", F.col("split").alias("old")), "source", "left")
    per = told.groupBy("root").agg(F.min("old").alias("old"), F.count_distinct("old").alias("splits"))
    if not per.where("splits > 1").isEmpty():
        raise LabelsRefused("a Match links sources of two splits")
    return owned.join(per.select("root", "old"), "root").select("source", "root", F.coalesce("old", model.bucket_split(F.col("root"))).alias("split"))


def with_splits(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """J-29: the pairs with their split; null where the ends stand in different splits, so that such pairs train nothing."""
    for side in ("left", "right"):
        pairs = pairs.join(assigned.select(F.col("source").alias(f"{side}_source"), F.col("split").alias(f"_{side}"), F.col("root").alias(f"{side}_root")), f"{side}_source")
    return pairs.withColumn("split", F.when(F.col("_left") == F.col("_right"), F.col("_left"))).drop("_left", "_right")


def partition_counts(split_pairs: DataFrame) -> DataFrame:
    """E-20: pairs by split and label; the null split holds the pairs that cross splits."""
    return split_pairs.groupBy("split", "human_label").agg(F.count(F.lit(1)).alias("n"))


def train_from_reviews(rows: DataFrame, features: list[str], known: DataFrame | None = None, target: float = 0.95) -> tuple[dict, DataFrame]:
    """L-9: a pair model of the eligible reviews, and the assignments it was fitted under.

    Splits are materialised before any weight is fitted, so a later refit can't move a held-out source into training.
    """
    model.checkpointed(rows.sparkSession)
    eligible = pair_states(rows).where("state = 'eligible'")
    assigned = assignments(eligible, known).checkpoint()
    ready = with_splits(eligible, assigned).where("split is not null").withColumn("y", (F.col("human_label") == "Match").cast("int"))
    parts = {k: ready.where(F.col("split") == k) for k in ("train", "validation")}
    for k, part in parts.items():
        if part.select("y").distinct().count() < 2:
            raise LabelsRefused(f"{k} needs both labels")
    return model.fit_pair_model(parts["train"], parts["validation"], features, "y", target), assigned

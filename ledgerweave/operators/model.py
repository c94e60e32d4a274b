"""Scoring, metrics and training of pair models (C-11..C-14, E-14..E-21, W-8..W-10, L-1..L-6, L-8, G-8)."""

from __future__ import annotations

import hashlib
import json
import math
import re
import tempfile
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sigmoid

#: the most rows that are fitted on the driver
FIT_ROWS = 100_000


def predict(weights: Mapping[str, float], intercept: float, platt: tuple[float, float] | None = None) -> Column:
    """C-12: logistic probability of named feature columns, null features as 0; optionally a clipped Platt layer."""
    z = sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in weights.items()), F.lit(float(intercept)))
    p = sigmoid(z)
    if platt:
        logit = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.log(p / (1 - p))))
        p = sigmoid(logit * platt[0] + platt[1])
    return p


def classification(df: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    """E-17: confusion counts, precision and recall; null on 0/0."""
    hit = F.col(p) >= threshold
    one = df.agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count_if(~hit & (F.col(y) == 0)).alias("tn"))
    return one.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    """E-14."""
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """E-15, E-16: every bin, empty ones too, with mean estimate, observed share and its part of the ECE."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    full = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return all_.join(full, "bin", "left").crossJoin(total).select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed", F.coalesce(F.col("n") / F.col("total") * F.abs(F.col("mean_p") - F.col("observed")), F.lit(0.0)).alias("ece_part"))


SLICES = 1024


def threshold_sweep(df: DataFrame, p: str, y: str) -> DataFrame:
    """W-8: one row per distinct score with counts at or above it.

    Scores aggregate first; running counts are taken in ``SLICES`` slices of 0..1 (others join the end slices), whose
    totals - one row a slice - are summed on their own, so no task orders all scores.
    """
    per = df.groupBy(F.col(p).alias("threshold")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("slice", F.least(F.greatest(F.floor(F.coalesce("threshold", F.lit(0.0)) * SLICES), F.lit(0)), F.lit(SLICES)))
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))  # at most SLICES + 1 rows
    totals = totals.select("slice", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("p", "m")])
    w = Window.partitionBy("slice").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.col("p") + F.sum("pos").over(w), F.col("m") + F.sum("n").over(w)
    out = per.join(F.broadcast(totals), "slice").select("threshold", tp.alias("tp"), (n - tp).alias("fp"))
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def best_threshold(df: DataFrame, p: str, y: str, target: float) -> float:
    """The threshold of most true positives at the target precision, then precision, then score; 1.0 if none."""
    row = threshold_sweep(df, p, y).where(F.col("precision") >= target).orderBy(F.desc("tp"), F.desc("precision"), F.desc("threshold")).first()
    return float(row.threshold) if row else 1.0


def feature_ranges(df: DataFrame, *features: str) -> DataFrame:
    """E-18: least and greatest of each feature, and whether it is constant."""
    one = df.agg(*[F.struct((F.min(f).cast("double") + 0.0).alias("low"), (F.max(f).cast("double") + 0.0).alias("high")).alias(f) for f in features])
    made = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.low").alias("low"), F.col(f"{f}.high").alias("high")) for f in features])).alias("r")
    return one.select(made).select("r.*", (F.col("r.low") == F.col("r.high")).alias("constant"))


def positional_split(df: DataFrame, key: str, seed: str, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """W-9: train, validation and test by rank of the seeded hash. Ranks come from counts of hash buckets plus a rank
    inside each, so no single task sorts all keys."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    rows = df.select(key).distinct().withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4,096 rows
    before = sizes.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = rows.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    split = F.when(F.col("_r") < F.floor(F.col("_n") * cuts[0]), "train").when(F.col("_r") < F.floor(F.col("_n") * cuts[1]), "validation").otherwise("test")
    return ranked.select(key, split.alias("split"))


def bucket_split(key: Column) -> Column:
    """W-10: split by the first 32 hash bits."""
    share = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(share < 0.6, "train").when(share < 0.75, "validation").when(share < 0.85, "calibration").otherwise("test")


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """L-1: groups that stand in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_faults(rows: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test"), least: int = 10) -> DataFrame:
    """L-1: (fault, key, n) of labelled pairs that can't be split as they are; no rows if they can.

    ``rows`` holds evaluation_id, pair_key, split, human_label, entity_group_ids and record_keys. Ids and pairs stand
    once, groups and records in one split; labels are definite, splits known, both ends named; each split has ``least`` rows
    and both labels. One shuffle: every row gives its keys, which aggregate before it.
    """
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    many = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: one(kind, k))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    eid = F.col("evaluation_id")
    bad = lambda kind, good: F.when(~F.coalesce(good, F.lit(False)), F.array(one(kind, eid))).otherwise(none)
    named = lambda c: F.forall(c, lambda k: F.coalesce(F.trim(k) != "", F.lit(False)))
    groups, ends = F.col("entity_group_ids"), F.col("record_keys")
    keys = F.concat(
        F.array(one("repeated evaluation", eid), one("repeated pair", F.col("pair_key")), one("split", F.col("split"))),
        F.coalesce(many("group in several splits", groups), none), F.coalesce(many("record in several splits", ends), none),
        bad("label", F.col("human_label").isin("Match", "NonMatch")), bad("unknown split", F.col("split").isin(*splits)),
        bad("groups", (F.size(groups) > 0) & named(groups)), bad("records", (F.size(ends) == 2) & named(ends) & (ends[0] != ends[1])),
        bad("no id", (F.trim(eid) != "") & (F.trim("pair_key") != "")),
    )
    spark = rows.sparkSession
    seen = rows.select(F.explode(keys).alias("k"), "split", "human_label", F.lit(1).alias("one")).select("k.*", "split", "human_label", "one")
    all_splits = spark.createDataFrame([("split", s, s, None, 0) for s in splits], "kind string, key string, split string, human_label string, one int")
    told = seen.unionByName(all_splits).groupBy("kind", "key").agg(F.sum("one").alias("n"), (F.min("split") != F.max("split")).alias("apart"), F.count_if(F.col("human_label") == "Match").alias("yes"), F.count_if(F.col("human_label") == "NonMatch").alias("no"))
    kind, n = F.col("kind"), F.col("n")
    small = (n < least) | (F.col("yes") == 0) | (F.col("no") == 0)
    wrong = F.when(kind.isin("repeated evaluation", "repeated pair"), (n > 1) & F.col("key").isNotNull()).when(kind.endswith("in several splits"), F.col("apart")).when(kind == "split", F.col("key").isin(*splits) & small).otherwise(True)
    return told.where(wrong).select(F.when(kind == "split", "small split or one label").otherwise(kind).alias("fault"), "key", "n")


class ModelRefused(ValueError):
    """A model artifact that isn't whole or doesn't fit its use."""


def unusable_features(df: DataFrame, *features: str) -> DataFrame:
    """S-37: rows with a feature that is null, not a number or outside 0..1."""
    good = [F.coalesce(F.col(f).cast("double").between(0, 1) & ~F.isnan(F.col(f).cast("double")), F.lit(False)) for f in features]
    return df.where(~F.forall(F.array(*good), lambda x: x))


def training_support(train: DataFrame, *features: str) -> dict:
    """S-37, E-18: rows, ranges and constants of the training features; unusable ones and no rows at all are refused."""
    if not unusable_features(train, *features).isEmpty():
        raise ModelRefused("features are numbers of 0..1")
    n, rows = train.count(), feature_ranges(train, *features).collect()  # one row a feature
    if not n:
        raise ModelRefused("no training rows")
    return {"rows": n, "ranges": {r.feature: [r.low, r.high] for r in rows}, "constants": {r.feature: r.low for r in rows if r.constant}}


def _model_id(artifact: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in artifact.items() if k != "model_id"}, sort_keys=True).encode()).hexdigest()


def model_artifact(fit: dict, support: dict, config_id: str, domain: str, calibration: dict | None = None) -> dict:
    """S-37: a fitted model as an artifact that names what it was made for and carries its own digest."""
    artifact = {"version": "pair-model-v1", "config_id": config_id, "domain": domain, "weights": dict(fit["weights"]), "intercept": fit["intercept"], "threshold": fit["threshold"], "support": support, "calibration": calibration}
    return artifact | {"model_id": _model_id(artifact)}


def check_artifact(artifact: dict, features: tuple[str, ...], config_id: str, domain: str) -> dict:
    """S-37: the artifact, if it is whole, unchanged and made for this configuration and domain; else ModelRefused.

    Coefficients are finite, those of features that were constant in training 0, ranges lie in 0..1, a calibration never
    turns the order round and rests on ten rows or more.
    """
    finite = lambda v: type(v) in (int, float) and math.isfinite(v)
    inside = lambda v: finite(v) and 0 <= v <= 1
    try:
        if artifact["version"] != "pair-model-v1" or (artifact["config_id"], artifact["domain"]) != (config_id, domain):
            raise ModelRefused("another version, configuration or domain")
        weights, support, calibration = artifact["weights"], artifact["support"], artifact["calibration"]
        if set(weights) != set(features) or not all(map(finite, [*weights.values(), artifact["intercept"]])):
            raise ModelRefused("one finite coefficient a feature")
        if not inside(artifact["threshold"]):
            raise ModelRefused("the threshold lies in 0..1")
        ranges = support["ranges"]
        if type(support["rows"]) is not int or support["rows"] < 1 or set(ranges) != set(features) or not all(inside(a) and inside(b) and a <= b for a, b in ranges.values()):
            raise ModelRefused("one range of 0..1 a feature")
        if support["constants"] != {f: a for f, (a, b) in ranges.items() if a == b} or any(weights[f] != 0 for f in support["constants"]):
            raise ModelRefused("features that were constant in training have no weight")
        if calibration is not None and not (finite(calibration["slope"]) and calibration["slope"] >= 0 and finite(calibration["intercept"]) and calibration["rows"] >= 10):
            raise ModelRefused("calibration")
        if artifact["model_id"] != _model_id(artifact):
            raise ModelRefused("the digest differs")
    except (KeyError, TypeError, ValueError) as e:
        raise e if isinstance(e, ModelRefused) else ModelRefused(f"not whole: {e!r}") from e
    return artifact


def fit_pair_model(train: DataFrame, validation: DataFrame, features: list[str], y: str, target: float = 0.95, penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2), rounds: int = 1800) -> dict:
    """L-2: full-batch logistic descent per penalty, constant features frozen at 0; best by validation recall, then Brier.

    Fits on the driver, on at most FIT_ROWS rows; more are refused rather than sampled.
    """
    rows = train.select(*[F.coalesce(f, F.lit(0.0)).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("_y")).limit(FIT_ROWS + 1).toPandas()
    if len(rows) > FIT_ROWS:
        raise ValueError(f"more than {FIT_ROWS} training rows")
    x, t = rows[features].to_numpy(), rows["_y"].to_numpy()
    live = x.max(0) > x.min(0)
    best: dict | None = None
    for penalty in penalties:
        w, b = np.zeros(len(features)), 0.0
        for _ in range(rounds):
            g = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - t
            w -= (x.T @ g / len(t) + penalty * w) * live
            b -= g.mean()
        weights = dict(zip(features, w.tolist(), strict=True))
        scored = validation.withColumn("_p", predict(weights, b)).withColumn("_t", F.col(y).cast("int"))
        cut = best_threshold(scored, "_p", "_t", target)
        recall = classification(scored, "_p", "_t", cut).first().recall or 0.0
        key = (recall, -(brier(scored, "_p", "_t").first().brier or 0.0))
        if best is None or key > best["key"]:
            best = {"weights": weights, "intercept": float(b), "threshold": cut, "penalty": penalty, "key": key}
    return best


def fit_platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 3000, rate: float = 0.01) -> tuple[float, float]:
    """L-3: slope (not negative) and intercept over clipped logits."""
    z = np.clip(np.log(np.clip(scores, 1e-12, 1 - 1e-12) / np.clip(1 - scores, 1e-12, 1)), -20, 20)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - labels
        a, b = max(0.0, a - rate * float((g * z).mean())), b - rate * float(g.mean())
    return a, b


def fit_calibration(rows: DataFrame, score: str, y: str, split: str = "split", group: str = "group", penalties: tuple[float, ...] = (0.001, 0.01, 0.1), rounds: int = 1500) -> dict:
    """L-4: slope and intercept of a logistic curve over one score, per penalty on the slope; the least validation Brier wins.

    Each split needs ten rows and both labels, scores lie in 0..1, and no group stands in two splits. Training rows
    aggregate to distinct (score, label) first; at most FIT_ROWS of these are fitted on the driver, more are refused.
    """
    sizes = {r[split]: r for r in rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(y).alias("kinds")).collect()}
    for k in ("train", "validation", "test"):
        if k not in sizes or sizes[k].n < 10 or sizes[k].kinds < 2:
            raise ValueError(f"{k} needs ten rows and both labels")
    if not rows.where(F.col(score).isNull() | ~F.col(score).between(0, 1)).isEmpty() or not leaks(rows, group, split).isEmpty():
        raise ValueError("scores must lie in 0..1 and no group in two splits")
    part = lambda k: rows.where(F.col(split) == k).select(F.col(score).cast("double").alias("x"), F.col(y).cast("int").alias("t"))
    few = part("train").groupBy("x", "t").agg(F.count(F.lit(1)).alias("n")).limit(FIT_ROWS + 1).toPandas()
    if len(few) > FIT_ROWS:
        raise ValueError(f"more than {FIT_ROWS} distinct training scores")
    x, t, share = few["x"].to_numpy(), few["t"].to_numpy(), few["n"].to_numpy() / few["n"].sum()
    best: dict | None = None
    for penalty in penalties:
        a, b = 1.0, 0.0
        for _ in range(rounds):
            g = share * (1 / (1 + np.exp(-np.clip(a * x + b, -40, 40))) - t)
            a, b = a - 0.5 * (float(g @ x) + penalty * a), b - 0.5 * float(g.sum())
        found = {"slope": a, "intercept": b, "penalty": penalty, "training_rows": int(few["n"].sum())}
        for k in ("validation", "test"):
            found[k] = brier(part(k).withColumn("p", sigmoid(F.col("x") * a + b)), "p", "t").first().brier
        if best is None or found["validation"] < best["validation"]:
            best = found
    return best


def fold_constants(weights: dict[str, float], intercept: float, constants: dict[str, float]) -> tuple[dict[str, float], float]:
    """L-5: the same predictions with constant features folded into the intercept."""
    return {f: 0.0 if f in constants else w for f, w in weights.items()}, intercept + sum(weights[f] * c for f, c in constants.items())


def max_change(df: DataFrame, p: Column, q: Column) -> DataFrame:
    """L-6: greatest difference of two predictions."""
    return df.agg(F.max(F.abs(p - q)).alias("max_change"))


def eligible_labels(decisions: DataFrame) -> DataFrame:
    """E-21, E-25, P-34, W-2, J-13, J-14: latest decision per evaluation, then one definite label per pair."""
    latest = decisions.groupBy("evaluation_id").agg(F.max_by(F.struct("pair_key", "human_label", "seq"), "seq").alias("d")).select("evaluation_id", "d.*")
    definite = latest.where(F.col("human_label").isin("Match", "NonMatch"))
    return definite.groupBy("pair_key").agg(F.max_by("human_label", "seq").alias("label"), F.count_distinct("human_label").alias("kinds")).where("kinds = 1").select("pair_key", "label")


def checkpointed(spark: SparkSession) -> None:
    """Makes sure a checkpoint folder is set: the one that spark.checkpoint.dir names; a local master without one gets its own, others raise."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def label_components(matches: DataFrame, rounds: int = 50) -> DataFrame:
    """G-8: (node, root) of source keys joined by Match pairs (a, b): smallest label spread until nothing changes."""
    checkpointed(matches.sparkSession)
    both = matches.select(F.col("a").alias("u"), F.col("b").alias("v")).union(matches.select("b", "a")).distinct().persist()
    now = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        near = both.join(now, both["v"] == now["node"]).groupBy("u").agg(F.min("root").alias("r"))
        then = now.join(near, now["node"] == near["u"]).select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")).checkpoint()
        moved = then.where("moved").limit(1).count()
        now = then.select("node", "root")
        if not moved:
            return now
    raise RuntimeError("labels did not settle")

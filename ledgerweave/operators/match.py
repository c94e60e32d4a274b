"""Candidate pairs and their scores (C-1..C-12, P-26, P-27, J-4..J-6, R-13..R-15, W-1, E-9, E-30)."""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_right
from dataclasses import asdict, dataclass, fields
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S
from .resolve import conflict_reasons, direct_identity, prepared


@dataclass(frozen=True)
class MatchConfig:
    """S-36: limits and weights of matching; out-of-range values are refused."""

    ngram_size: int = 3
    min_shared_grams: int = 2
    max_posting: int = 150
    max_candidates_per_record: int = 40
    max_evaluations: int = 50_000
    max_feature_chars: int = 256
    review_threshold: float = 0.88
    near_miss_floor: float = 0.80
    excluded_tax_sample_size: int = 100
    random_seed: int = 1729
    name_weight: float = 0.70
    address_weight: float = 0.20
    postcode_weight: float = 0.10
    graph_blocking: bool = True
    soundex: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            whole, number = type(v) is int and v >= 0, type(v) in (int, float) and 0 <= v <= 1
            if not {"int": whole, "float": number, "bool": type(v) is bool}[f.type]:
                raise ValueError(f"{f.name} = {v!r}")
        least = {"min_shared_grams": 1, "max_posting": 2, "max_candidates_per_record": 1, "max_evaluations": 1}
        if low := [name for name, n in least.items() if getattr(self, name) < n]:
            raise ValueError(f"too small: {low}")
        if not 2 <= self.ngram_size <= 5 or not 16 <= self.max_feature_chars <= 1000:
            raise ValueError("grams are of 2 to 5 letters, features of 16 to 1000")
        if not self.near_miss_floor < self.review_threshold or self.name_weight == 0:
            raise ValueError("near_miss_floor lies below review_threshold, name_weight above 0")

    @property
    def config_id(self) -> str:
        """Digest of the configuration's canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class BudgetExceeded(RuntimeError):
    """C-5: more candidates than may be evaluated; never a silent cut."""


def postings(s: DataFrame, cfg: MatchConfig = MatchConfig(), ascii_only: bool = False) -> DataFrame:
    """C-1: distinct (rid, method, key): name grams, Soundex and, within a country, shared identifiers and postcode."""
    names = F.array(F.col("name"))
    if "aliases" in s.columns:
        names = F.concat(names, F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.trim(a) != ""))
    key = lambda method, value: F.struct(F.lit(method).alias("method"), value.alias("key"))
    rows = s.select("*", F.explode(names).alias("variant")).withColumn("nk", S.name_key("variant", ascii_only))
    grams = F.transform(S.ngrams("nk", cfg.ngram_size), lambda g: key("ngram", g))
    keys = [grams]
    if cfg.soundex:
        sx = S.soundex_key("variant", ascii_only)
        keys.append(F.when(sx != "", F.array(key("soundex", sx))).otherwise(F.array().cast("array<struct<method:string,key:string>>")))
    if cfg.graph_blocking:
        for f in ("registration_id", "tax_id", "lei", "bank_account_hash", "postcode"):
            if f in s.columns:
                v = (S.authority if f in ("registration_id", "tax_id") else S.identifier)(f)
                scoped = v if f == "lei" else F.concat("country", F.lit(":"), v)
                keys.append(F.when(v != "", F.array(key("graph_" + f, scoped))).otherwise(F.array().cast("array<struct<method:string,key:string>>")))
    return rows.select(F.col("supplier_id").alias("rid"), F.explode(F.concat(*keys)).alias("k")).select("rid", "k.method", "k.key").distinct()


def bounded(posts: DataFrame, limit: int) -> DataFrame:
    """P-26: postings no longer than the limit. Counted before the self-join, so a hot key never meets itself."""
    sizes = posts.groupBy("method", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= limit) & (F.col("n") > 1)).select("method", "key")
    return posts.join(sizes, ["method", "key"])


def candidates(posts: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """C-2..C-4, P-27: (left_id, right_id, methods): pairs either side ranks among its best neighbours."""
    kept = bounded(posts, cfg.max_posting)
    a, b = kept.select(F.col("rid").alias("a"), "method", "key"), kept.select(F.col("rid").alias("b"), "method", "key")
    met = a.join(b, ["method", "key"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("method")).alias("methods"))
    strong = F.array_contains("methods", "soundex") | F.exists("methods", lambda m: m.startswith("graph_")) | (F.col("hits") >= cfg.min_shared_grams)
    met = met.where(strong)
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "hits", "methods"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("hits"), "b"))
    best = both.withColumn("rank", rank).where(F.col("rank") <= cfg.max_candidates_per_record)
    return best.groupBy(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).agg(F.max("hits").alias("hits"), F.any_value("methods").alias("methods"))


def within_budget(pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """C-5: the pairs, if they may all be evaluated. Costs a count, so callers that don't need the limit leave it out."""
    if (n := pairs.count()) > cfg.max_evaluations:
        raise BudgetExceeded(f"{n} pairs exceed {cfg.max_evaluations}")
    return pairs


def statistics(s: DataFrame, posts: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """C-6: one row of counts."""
    big = posts.groupBy("method", "key").count().where(F.col("count") > cfg.max_posting).agg(F.count(F.lit(1)).alias("oversized_postings"))
    n = s.agg(F.count(F.lit(1)).alias("records"))
    return n.crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs"))).crossJoin(big).withColumn("possible_pairs", F.expr("records * (records - 1) div 2"))  # one row each


def features(s: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig(), ascii_only: bool = False) -> DataFrame:
    """C-8..C-11: similarities of each pair; null where a side has nothing to compare."""
    address = S.tokens("address", ascii_only) if "address" in s.columns else F.array().cast("array<string>")
    side = s.select("supplier_id", F.substring(S.name_key("name", ascii_only), 1, cfg.max_feature_chars).alias("nk"), address.alias("addr"), S.identifier("postcode").alias("pc"))
    joined = pairs
    for t, i in (("l", "left_id"), ("r", "right_id")):
        joined = joined.join(side.select(F.col("supplier_id").alias(i), F.struct("nk", "addr", "pc").alias(t)), i)
    nk = (F.col("l.nk"), F.col("r.nk"))
    words = [F.filter(F.split(x, " "), lambda w: w != "") for x in nk]
    name = S.levenshtein_similarity(*nk, cfg.max_feature_chars)
    addr = S.jaccard(F.col("l.addr"), F.col("r.addr"))
    post = F.when((F.col("l.pc") != "") & (F.col("r.pc") != ""), (F.col("l.pc") == F.col("r.pc")).cast("double"))
    return joined.select(
        *pairs.columns, name.alias("name_levenshtein"), S.dice(S.ngrams(nk[0]), S.ngrams(nk[1])).alias("name_trigram_dice"), F.coalesce(S.jaccard(*words), F.lit(0.0)).alias("name_token_jaccard"),
        S.levenshtein_similarity(S.sorted_words(nk[0]), S.sorted_words(nk[1])).alias("name_sorted_levenshtein"), addr.alias("address_jaccard"), post.alias("postcode_exact"),
    )


def weighted_score(cfg: MatchConfig = MatchConfig()) -> Column:
    """C-8: mean of the features that could be measured, by their weights."""
    parts = (("name_levenshtein", cfg.name_weight), ("address_jaccard", cfg.address_weight), ("postcode_exact", cfg.postcode_weight))
    top = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in parts), F.lit(0.0))
    return top / sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in parts), F.lit(0.0))


def pair_at(x: int) -> tuple[int, int]:
    """The x-th pair (i, j), i < j, if pairs are counted by j, then by i."""
    j = (1 + math.isqrt(1 + 8 * x)) // 2
    return x - j * (j - 1) // 2, j


def excluded_tax_sample(s: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """C-7, J-6: pairs that share a tax id but aren't candidates: a seeded uniform sample, with the population.

    The reference draws with a sequential generator; this draw has the same size, population and probability and does
    not depend on row order. The population is counted by arithmetic. Pairs are listed only if they are at most twice as
    many as the candidates among them, or twenty times the sample; else numbers of pairs are drawn, those of candidates
    thrown back, so a tax id of very many records is never joined with itself. Ids of records are unique.
    """
    size = cfg.excluded_tax_sample_size
    rows = prepared(s).where("tax_id <> ''").select("supplier_id", "tax_id").distinct()
    n = F.col("n").cast("decimal(18,0)")
    taxes = rows.groupBy("tax_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tax_id", F.substring(F.sha2("tax_id", 256), 1, 3).alias("b"), (n * (n - 1) / 2).cast("decimal(38,0)").alias("weight"))
    known = pairs.select("left_id", "right_id").distinct().join(rows.toDF("left_id", "tax_id"), "left_id").join(rows.toDF("right_id", "tax_id"), ["right_id", "tax_id"]).select("left_id", "right_id")
    buckets = sorted((r.b, int(r.w)) for r in taxes.groupBy("b").agg(F.sum("weight").cast("decimal(38,0)").alias("w")).collect())  # at most 4,096 rows
    total, taken = sum(w for _, w in buckets), known.count()
    population = total - taken
    if total <= 2 * taken + 20 * size:
        left, right = rows.toDF("left_id", "tax_id"), rows.toDF("right_id", "tax_id")
        missed = left.join(right, "tax_id").where("left_id < right_id").select("left_id", "right_id").join(known, ["left_id", "right_id"], "left_anti")
        drawn = missed.orderBy(F.sha2(F.concat_ws(":", F.lit(str(cfg.random_seed)), "left_id", "right_id"), 256)).limit(size)
    else:
        drawn = _drawn_pairs(rows, taxes, known, buckets, total, size, cfg.random_seed)
    return drawn.select("left_id", "right_id", F.lit(population).cast("decimal(38,0)").alias("population"), F.lit(min(1.0, size / population) if population else 1.0).alias("sampling_probability"))


def _drawn_pairs(rows: DataFrame, taxes: DataFrame, known: DataFrame, buckets: list[tuple[str, int]], total: int, size: int, seed: int) -> DataFrame:
    """``size`` pairs of a tax id, none of ``known``, in the order in which their numbers are drawn. Fewer than half of all
    pairs are known. Collects a few rows a draw; records are ranked in cells of their tax id, so no task sorts all of one."""
    spark, kind = rows.sparkSession, rows.schema["supplier_id"].dataType.simpleString()
    ends = list(accumulate(w for _, w in buckets))
    placed = taxes.withColumn("first", F.sum("weight").over(Window.partitionBy("b").orderBy("tax_id")).cast("decimal(38,0)") - F.col("weight"))
    m = 4 * size + 40
    while True:
        numbers = dict.fromkeys(int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), 16) % total for k in range(m))
        at = [(k, bisect_right(ends, x), x) for k, x in enumerate(numbers)]
        draws = spark.createDataFrame([(k, buckets[i][0], Decimal(x - (ends[i] - buckets[i][1]))) for k, i, x in at], "k int, b string, x decimal(38,0)")
        inside = (F.col("x") >= F.col("first")) & (F.col("x") - F.col("first") < F.col("weight"))
        hits = placed.join(F.broadcast(draws), "b").where(inside).select("k", "tax_id", (F.col("x") - F.col("first")).alias("x")).collect()  # m rows
        asked = spark.createDataFrame([(r.k, r.tax_id, rank) for r in hits for rank in pair_at(int(r.x))], "k int, tax_id string, rank long")
        members = rows.join(F.broadcast(asked.select("tax_id").distinct()), "tax_id", "left_semi").withColumn("cell", F.substring(F.sha2(F.col("supplier_id").cast("string"), 256), 1, 3))
        cells = members.groupBy("tax_id", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most 4,096 a tax id
        cells = cells.withColumn("first", F.sum("n").over(Window.partitionBy("tax_id").orderBy("cell")) - F.col("n"))
        wanted = cells.join(F.broadcast(asked), "tax_id").where("rank >= first and rank < first + n").select("k", "tax_id", "cell", (F.col("rank") - F.col("first")).alias("nth"))
        nth = (F.row_number().over(Window.partitionBy("tax_id", "cell").orderBy("supplier_id")) - 1).alias("nth")
        ranked = members.join(wanted.select("tax_id", "cell").distinct(), ["tax_id", "cell"], "left_semi").select("tax_id", "cell", "supplier_id", nth)
        found = wanted.join(ranked, ["tax_id", "cell", "nth"]).groupBy("k").agg(F.min("supplier_id").alias("left_id"), F.max("supplier_id").alias("right_id"))
        fresh = sorted(found.join(known, ["left_id", "right_id"], "left_anti").select("k", "left_id", "right_id").collect())  # m rows at most
        if len(fresh) >= size:
            return spark.createDataFrame([tuple(r)[1:] for r in fresh[:size]], f"left_id {kind}, right_id {kind}")
        m *= 2


def augmented(pairs: DataFrame, graph_pairs: DataFrame) -> DataFrame:
    """G-6, J-9: candidates and the pairs that only the graph finds; all are evaluated."""
    return pairs.select("left_id", "right_id").unionByName(graph_pairs.select("left_id", "right_id")).distinct()


def evaluated(s: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig(), ascii_only: bool = False, sampled: DataFrame | None = None) -> DataFrame:
    """R-15 and steps 1 and 4 of the outcome order: score, near miss, conflict reasons, outcome, tier."""
    rows = pairs.select("left_id", "right_id").withColumn("sampled", F.lit(False))
    if sampled is not None:
        rows = rows.unionByName(sampled.select("left_id", "right_id").withColumn("sampled", F.lit(True)))
    scored = features(s, rows, cfg, ascii_only).withColumn("score", weighted_score(cfg))
    ids = prepared(s)
    for t, i in (("l", "left_id"), ("r", "right_id")):
        scored = scored.join(ids.select(F.col("supplier_id").alias(i), F.struct(*[c for c in ids.columns if c != "supplier_id"]).alias(t)), i)
    scored = scored.withColumn("reasons", conflict_reasons()).withColumn("direct", direct_identity()).drop("l", "r")
    base = F.when(F.col("score") >= cfg.review_threshold, "Review_Candidate").otherwise("Below_Threshold")
    outcome = F.when(F.col("sampled"), "Excluded_Sampled").when(F.size("reasons") > 0, "Conflict_Review").otherwise(base)
    tier = F.when(F.col("sampled"), "Excluded_Diagnostic").when(F.size("reasons") > 0, "Conflict_Review").when(F.col("outcome") == "Review_Candidate", "Uncalibrated_Review").otherwise("Uncalibrated_Diagnostic")
    near = ~F.col("sampled") & (F.col("score") >= cfg.near_miss_floor) & (F.col("score") < cfg.review_threshold)
    return scored.withColumn("outcome", outcome).withColumn("tier", tier).withColumn("near_miss", near)


def governed(evaluations: DataFrame, members: DataFrame, graph_pairs: DataFrame | None = None, probability: str | None = None) -> DataFrame:
    """R-13, R-14, J-28: steps 4 to 6 of the outcome order: calibrated tiers, graph context, one entity's pairs."""
    e = evaluations
    if probability:
        p = F.col(probability)
        strong = (p >= 0.99) & (F.size("direct") > 0)
        tier = F.when(F.col("tier").isin("Excluded_Diagnostic", "Conflict_Review"), F.col("tier")).when(p < 0.75, "Separate_Diagnostic").when(strong, "Exact_Identity_Eligible").otherwise("Human_Review")
        e = e.withColumn("tier", tier).withColumn("outcome", F.when(F.col("outcome").isin("Excluded_Sampled", "Conflict_Review"), F.col("outcome")).when(F.col("tier") == "Separate_Diagnostic", "Below_Threshold").otherwise("Review_Candidate"))
    if graph_pairs is not None:
        e = e.join(graph_pairs.select("left_id", "right_id", F.lit(True).alias("in_graph")).distinct(), ["left_id", "right_id"], "left")
        weak = F.col("in_graph") & F.col("outcome").isin("Below_Threshold", "Excluded_Sampled")
        e = e.withColumn("outcome", F.when(weak, "Graph_Context_Review").otherwise(F.col("outcome"))).drop("in_graph")
    for t, i in (("lm", "left_id"), ("rm", "right_id")):
        e = e.join(members.select(F.col("supplier_id").alias(i), F.col("root").alias(t)), i)
    same = (F.col("lm") == F.col("rm")) & (F.col("outcome") != "Excluded_Sampled")
    return e.withColumn("outcome", F.when(same, "Authority_Grouped").otherwise(F.col("outcome"))).drop("lm", "rm")


def review_queue(evaluations: DataFrame, tax_reviews: DataFrame, cluster_reviews: DataFrame) -> DataFrame:
    """R-12, O-13: one reason a pair; cluster failures overwrite shared-tax reviews, evaluation outcomes fill what is left."""
    own = evaluations.where(F.col("outcome").isin("Review_Candidate", "Conflict_Review", "Graph_Context_Review")).select("left_id", "right_id", F.col("outcome").alias("reason"), F.lit(2).alias("rank"))
    tax = tax_reviews.select("left_id", "right_id", F.lit("shared_tax_id").alias("reason"), F.lit(1).alias("rank"))
    broken = cluster_reviews.select("left_id", "right_id", F.lit("cluster_conflict").alias("reason"), F.lit(0).alias("rank"))
    return own.unionByName(tax).unionByName(broken).groupBy("left_id", "right_id").agg(F.min_by("reason", "rank").alias("reason"))

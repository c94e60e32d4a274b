"""Knowledge graph and association paths (G-1..G-7, J-7..J-9, J-23, J-25, P-32, W-18)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S

RELATIONS = {"registration_id": "HAS_REGISTRATION", "lei": "HAS_LEI", "parent_lei": "ASSOCIATED_WITH", "tax_id": "HAS_TAX_ID", "bank_account_hash": "HAS_BANK_HASH", "postcode": "SHARES_POSTCODE"}


@dataclass(frozen=True)
class GraphPolicy:
    """S-36, G-5: limits of path discovery; out-of-range values are refused."""

    max_posting: int = 40
    max_neighbors: int = 40
    max_paths: int = 2
    max_expansions: int = 20_000

    def __post_init__(self) -> None:
        if any(type(getattr(self, f.name)) is not int or getattr(self, f.name) < 1 for f in fields(self)) or self.max_posting < 2 or self.max_paths > 5:
            raise ValueError("limits are positive integers, postings of two rows or more, at most five paths")

    @property
    def policy_id(self) -> str:
        """Digest of the policy's canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


class ExpansionBudget(RuntimeError):
    """G-5: more path expansions than the policy allows."""


def attributes(s: DataFrame, ascii_only: bool = False) -> DataFrame:
    """G-3: distinct (rid, node, relation, kind); a parent's LEI shares the LEI nodes, and wins over a record's own."""
    made = []
    for f, relation in RELATIONS.items():
        if f in s.columns:
            v = (S.authority if f in ("registration_id", "tax_id") else S.identifier)(f)
            kind = "lei" if f == "parent_lei" else f
            scope = v if kind == "lei" else F.concat(F.coalesce("country", F.lit("ZZ")), F.lit(":"), v)
            made.append(F.when(v != "", F.struct(S.node_id(kind, scope).alias("node"), F.lit(relation).alias("relation"), F.lit(kind).alias("kind"))))
    if "address" in s.columns:
        words = S.tokens("address", ascii_only)
        text = F.array_join(words, " ")
        made.append(F.when((F.length(text) >= 12) & (F.size(words) >= 3), F.struct(S.node_id("address", F.concat(F.coalesce("country", F.lit("ZZ")), F.lit(":"), text)).alias("node"), F.lit("SHARES_ADDRESS").alias("relation"), F.lit("address").alias("kind"))))
    rows = s.select(F.col("supplier_id").alias("rid"), F.explode(F.array_compact(F.array(*made))).alias("a")).select("rid", "a.node", "a.relation", "a.kind")
    return rows.groupBy("rid", "node", "kind").agg(F.min("relation").alias("relation"))  # ASSOCIATED_WITH < HAS_LEI


def nodes(s: DataFrame, spend: DataFrame, members: DataFrame, ascii_only: bool = False) -> DataFrame:
    """G-1: (node_id, kind, label), one row a node."""
    named = s.join(members, "supplier_id")
    parts = [
        named.groupBy("entity_id").agg(F.min_by("name", "supplier_id").alias("label")).select(F.concat(F.lit("entity:"), "entity_id").alias("node_id"), F.lit("entity").alias("kind"), "label"),
        s.select(F.concat(F.lit("supplier:"), "supplier_id"), F.lit("supplier"), "name"),
        spend.select(F.concat(F.lit("invoice:"), "invoice_id"), F.lit("invoice"), F.col("invoice_id")).distinct(),
        spend.select(F.concat(F.lit("category:"), "category"), F.lit("category"), F.col("category")).distinct(),
        attributes(s, ascii_only).select("node", "kind", F.col("kind").alias("label")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(s: DataFrame, spend: DataFrame, members: DataFrame, ascii_only: bool = False) -> DataFrame:
    """G-1, G-7: distinct (source, relation, target)."""
    out = members.select(F.concat(F.lit("supplier:"), "supplier_id").alias("source"), F.lit("RESOLVED_TO").alias("relation"), F.concat(F.lit("entity:"), "entity_id").alias("target"))
    out = out.union(spend.select(F.concat(F.lit("invoice:"), "invoice_id"), F.lit("BILLED_BY"), F.concat(F.lit("supplier:"), "supplier_id")).distinct())
    out = out.union(spend.select(F.concat(F.lit("invoice:"), "invoice_id"), F.lit("IN_CATEGORY"), F.concat(F.lit("category:"), "category")).distinct())
    return out.union(attributes(s, ascii_only).select(F.concat(F.lit("supplier:"), "rid"), "relation", "node"))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """Edges at each node, as source or target (J-25): two aggregates, no OR join."""
    both = edge_rows.groupBy(F.col("source").alias("node_id")).count().union(edge_rows.groupBy("target").count())
    return both.groupBy("node_id").agg(F.sum("count").alias("degree"))


def neighbors(edge_rows: DataFrame, node_id: str, hops: int = 1, limit: int | None = 500, max_posting: int = 200, relation: str | None = None) -> DataFrame:
    """G-2: nodes within one or two hops, the first ``limit`` of them (None: all); nodes with more than ``max_posting`` edges are reached but not expanded."""
    if hops not in (1, 2) or not (limit is None or 1 <= limit <= 500):
        raise ValueError("hops must be 1 or 2 and limit 1..500")
    e = edge_rows if relation is None else edge_rows.where(F.col("relation") == relation)
    around = e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source"))
    small = degrees(e).where(F.col("degree") <= max_posting).select(F.col("node_id").alias("a"))
    open_ = around.join(small, "a", "left_semi")
    found = open_.where(F.col("a") == node_id).select(F.col("b").alias("node_id"), F.lit(1).alias("hop"))
    if hops == 2:
        found = found.union(open_.join(found.select(F.col("node_id").alias("a")), "a").select("b", F.lit(2)))
    near = found.where(F.col("node_id") != node_id).groupBy("node_id").agg(F.min("hop").alias("hop"))
    return near if limit is None else near.orderBy("hop", "node_id").limit(limit)


def neighborhood(edge_rows: DataFrame, node_id: str, hops: int = 1, limit: int = 500, max_posting: int = 200, relation: str | None = None) -> tuple[DataFrame, bool]:
    """G-2: the nodes of ``neighbors`` with ``expanded`` (false for those with more than ``max_posting`` edges), and whether the limit cut any off."""
    found = neighbors(edge_rows, node_id, hops, limit, max_posting, relation)
    e = edge_rows if relation is None else edge_rows.where(F.col("relation") == relation)
    big = degrees(e).where(F.col("degree") > max_posting).select("node_id", F.lit(False).alias("expanded"))
    every = neighbors(edge_rows, node_id, hops, None, max_posting, relation)
    return found.join(big, "node_id", "left").fillna(True, ["expanded"]), every.limit(limit + 1).count() > limit


def two_edge_paths(attrs: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """J-7: ordered (start, node, end) through a node that isn't oversized; sizes are cut before the self-join."""
    small = attrs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= policy.max_posting)).select("node")
    kept = attrs.join(small, "node")
    a = kept.select("node", F.col("rid").alias("start"), F.col("relation").alias("r1"), "kind")
    return a.join(kept.select("node", F.col("rid").alias("end"), F.col("relation").alias("r2")), "node").where("start <> end")


def four_edge_paths(attrs: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """J-8: (start, node, middle, node2, end) whose relations hold an ownership and an address or legal key."""
    one = two_edge_paths(attrs, policy)
    first = one.select("start", "node", F.col("end").alias("middle"), "r1", "r2")
    then = one.select(F.col("start").alias("middle"), F.col("node").alias("node2"), "end", F.col("r1").alias("r3"), F.col("r2").alias("r4"))
    paths = first.join(then, "middle").where("node <> node2 and start <> end")
    kinds = F.array("r1", "r2", "r3", "r4")
    legal = F.arrays_overlap(kinds, F.array(*map(F.lit, ("SHARES_ADDRESS", "HAS_REGISTRATION", "HAS_LEI"))))
    return paths.where(F.array_contains(kinds, "ASSOCIATED_WITH") & legal)


def association_pairs(s: DataFrame, policy: GraphPolicy = GraphPolicy(), ascii_only: bool = False) -> DataFrame:
    """G-4, W-18: (left_id, right_id, hops, n_paths): each record's nearest ends, at most ``max_neighbors``."""
    attrs = attributes(s, ascii_only)
    two, four = two_edge_paths(attrs, policy), four_edge_paths(attrs, policy)
    if (n := two.count() + four.count()) > policy.max_expansions:
        raise ExpansionBudget(f"{n} expansions exceed {policy.max_expansions}")
    ends = two.groupBy("start", "end").agg(F.lit(2).alias("hops"), F.count(F.lit(1)).alias("n")).union(four.groupBy("start", "end").agg(F.lit(4), F.count(F.lit(1))))
    best = ends.groupBy("start", "end").agg(F.min("hops").alias("hops"), F.least(F.sum("n"), F.lit(policy.max_paths)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("hops", "end"))
    kept = best.withColumn("rank", rank).where(F.col("rank") <= policy.max_neighbors)
    return kept.groupBy(F.least("start", "end").alias("left_id"), F.greatest("start", "end").alias("right_id")).agg(F.min("hops").alias("hops"), F.max("n").alias("n_paths"))


def bounded_state(node_rows: DataFrame, edge_rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """P-32, J-23: the first nodes by id and the edges that have both ends among them."""
    shown = node_rows.orderBy("node_id").limit(limit)
    ids = F.broadcast(shown.select("node_id"))  # at most `limit` rows
    return shown, edge_rows.join(ids, edge_rows["source"] == ids["node_id"], "left_semi").join(ids, edge_rows["target"] == ids["node_id"], "left_semi")

"""Q-1: a deterministic question router that compiles to a small plan over spend (P-11, E-3, W-3, W-13)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import spend as E

#: fixed values: words that carry no restriction
QUERY_WORDS = set(
    """what is the total totals spend spent net by currency currencies show me please all imported
    suppliers supplier for of on from and or to in our we have has how much money did do does a an are
    this these those which highest top invoice invoices payment payments published duplicate duplicates identity identities resolve
    resolved matched matching merge evidence amount amounts summary give tell list entity entities with
    review candidate candidates find identify display explain i want can you record records vendor vendors""".split()
)
IDENTITY_WORDS = {"duplicate", "duplicates", "identity", "identities", "resolve", "resolved", "matched", "matching", "merge"}
SPEND_WORDS = {"spend", "spent", "total", "totals", "amount", "amounts", "payments", "payment", "money", "highest", "top", "summary"}


@dataclass(frozen=True)
class QueryPlan:
    """What a question asks for; unknown words mean a person must look, and no total is given."""

    intent: str
    suppliers: tuple[str, ...] | None
    currencies: tuple[str, ...] | None
    unknown: tuple[str, ...]


def phrase_in(phrase: str, text: str) -> bool:
    """S-21: whole phrase, not part of a longer word or id."""
    return re.search(rf"(?<![\w-]){re.escape(phrase)}(?![\w-])", text, re.I) is not None


def parse(question: str, suppliers: dict[str, str], currencies: set[str]) -> QueryPlan:
    """``suppliers`` maps id to name. A name made of query words only needs a scoping word before it."""
    if not 0 < len(question) <= 1000:
        raise ValueError("question must have 1..1000 characters")
    named, left = [], question
    for sid, name in sorted(suppliers.items(), key=lambda x: -len(x[1])):
        plain = all(w in QUERY_WORDS for w in name.lower().split())
        if phrase_in(sid, question) or (name and not plain and phrase_in(name, question)) or (name and plain and re.search(rf"\b(?:for|from|supplier|vendor)\s+{re.escape(name)}\b", question, re.I)):
            named.append(sid)
            left = re.sub(rf"(?<![\w-])(?:{re.escape(sid)}|{re.escape(name)})(?![\w-])", " ", left, flags=re.I)
    codes = [c for c in re.findall(r"\b[A-Z]{3}\b", left) if c in currencies or c.lower() not in QUERY_WORDS or re.search(rf"\bin {c}\b", left)]
    rest = [w for w in re.findall(r"[\w-]+", left) if w not in codes]
    unknown = tuple(w for w in rest if w.lower() not in QUERY_WORDS)
    words = {w.lower() for w in rest}
    intent = "needs_review" if unknown else "supplier_resolution" if words & IDENTITY_WORDS else "spend_summary" if words & SPEND_WORDS else "needs_review"
    return QueryPlan(intent, tuple(sorted(named)) or None, tuple(codes) or None, unknown)


def run(plan: QueryPlan, spend: DataFrame, members: DataFrame) -> DataFrame | None:
    """Totals per currency of the scope, or its entities; None where a person must look."""
    if plan.intent == "spend_summary":
        return E.totals(E.scoped(spend, list(plan.suppliers) if plan.suppliers else None, list(plan.currencies) if plan.currencies else None))
    if plan.intent == "supplier_resolution":
        return members if plan.suppliers is None else members.where(members["supplier_id"].isin(list(plan.suppliers)))
    return None

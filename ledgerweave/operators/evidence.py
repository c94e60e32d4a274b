"""Evidence, audit chain and decisions (P-12, P-13, S-22, W-2, W-13, W-15..W-17, J-17, J-18, E-23, E-29, X-9, K-2, K-3, O-3, P-31)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as S

GENESIS = "0" * 64


def excerpt(*cols: str):
    """P-12: 'name: value; ...' of the original columns."""
    return F.concat_ws("; ", *[F.concat(F.lit(c + ": "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])


#: fixed values: what a staged action shows of its records and of itself
SOURCE_FIELDS = ("supplier_id", "name", "country", "registration_id", "tax_id", "postcode", "address", "lei", "parent_lei", "bank_account_hash")
INTENT_FIELDS = ("action_id", "snapshot", "entity_id", "operation", "target_binding", "payload", "source_records")


def source_records(s: DataFrame) -> DataFrame:
    """P-13: records as an action carries them; what a source lacks is ''."""
    return s.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in s.columns else F.lit("")).alias(c) for c in SOURCE_FIELDS])


def intents(actions: DataFrame) -> DataFrame:
    """P-13: what an action intends, with the digest that binds it."""
    rows = actions.select(*INTENT_FIELDS)
    return rows.withColumn("intent_hash", S.fingerprint(*[F.col(c) for c in sorted(INTENT_FIELDS)]))


def pending_dispatch(outbox: DataFrame, jobs: DataFrame, now: float, limit: int | None = 100, again: float = 30.0) -> DataFrame:
    """J-18: messages of queued or running jobs that were never published under their epoch, or longer than ``again`` seconds
    ago; oldest first. ``limit`` is how many one round hands out (None: all)."""
    due = outbox.where((F.col("epoch") > F.col("published_epoch")) | (F.col("last_published") < now - again))
    live = jobs.where(F.col("state").isin("queued", "running")).select("action_id", "intent_hash", "state")
    rows = due.join(live, "action_id")
    return rows if limit is None else rows.orderBy("last_published", "action_id").limit(limit)


def event_hash(previous, timestamp, event, payload):
    return F.sha2(F.concat_ws("\n", previous, timestamp, event, payload), 256)


def chain(events: DataFrame, group: str = "chain") -> DataFrame:
    """W-15: hashes events in order of sequence, each with the one before; chains are independent tasks."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, out = rows.sort_values("sequence"), GENESIS, []
        for r in rows.itertuples():
            digest = hashlib.sha256("\n".join((last, r.timestamp, r.event, r.payload)).encode()).hexdigest()
            out.append((last, digest))
            last = digest
        rows[["previous_hash", "event_hash"]] = out
        return rows

    kind = events.schema[group].dataType.simpleString()
    return events.select(group, "sequence", "timestamp", "event", "payload").groupBy(group).applyInPandas(one, f"{group} {kind}, sequence long, timestamp string, event string, payload string, previous_hash string, event_hash string")


def broken_links(chained: DataFrame, group: str = "chain") -> DataFrame:
    """W-16: events whose stored hashes don't follow; every row is recomputed on its own from the stored previous hash."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy("sequence")
    want = F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))
    good = (F.col("previous_hash") == want) & (F.col("event_hash") == event_hash("previous_hash", "timestamp", "event", "payload"))
    return chained.withColumn("good", good).where("not good").drop("good")


def chain_coverage(events: DataFrame, links: DataFrame, *keys: str) -> DataFrame:
    """J-17, E-29: one row: events, links, events without a link, links without an event, links whose contents differ.

    ``events`` holds what is hashed (timestamp, event, payload), ``links`` both hashes; they meet on ``keys``.
    """
    told = F.struct("timestamp", "event", "payload")
    a, b = events.select(*keys, told.alias("told")), links.select(*keys, "previous_hash", "event_hash")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(keys), "full")
    differs = F.col("_a") & F.col("_b") & (event_hash("previous_hash", "told.timestamp", "told.event", "told.payload") != F.col("event_hash"))
    return both.agg(
        F.count("_a").alias("events"), F.count("_b").alias("links"), F.count_if(F.col("_b").isNull()).alias("unlinked"), F.count_if(F.col("_a").isNull()).alias("orphans"), F.count_if(differs).alias("altered")
    )


def with_stale(actions: DataFrame, snapshot: str, column: str = "snapshot_id") -> DataFrame:
    """W-17: actions with ``stale``: made under another snapshot than the current one; unknown snapshots are stale."""
    return actions.withColumn("stale", ~F.col(column).eqNullSafe(F.lit(snapshot)))


def pack_evidence(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """W-13: (key, used, kept, items): per key, in order, every item that still fits the budget, later small ones too.

    A key's rows pass one task in order, which keeps three numbers of them, whatever their count; null sizes count 0.
    """
    rows = items.select(F.col(key).alias("key"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("n"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used, kept, seen = None, 0, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for k, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if not seen or k != here:
                    if seen:
                        out.append((here, used, kept, seen))
                    here, used, kept, seen = k, 0, 0, 0
                seen += 1
                if used + n <= budget:
                    used, kept = used + n, kept + 1
        if seen:
            out.append((here, used, kept, seen))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], [key, "used", "kept", "items"])

    kind = to_arrow_type(rows.schema["key"].dataType)
    ordered = rows.repartition("key").sortWithinPartitions("key", "o").select("key", "n")
    return ordered.mapInArrow(fold, f"`{key}` {rows.schema['key'].dataType.simpleString()}, used long, kept long, items long")


def latest(df: DataFrame, key: str, seq: str, *cols: str) -> DataFrame:
    """W-2: the newest row of each key, by aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(seq, *cols), seq).alias("r")).select(key, "r.*")


def page(df: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    """P-31, O-3: one page of bounded size."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int, offset: int, *order) -> tuple[DataFrame, int]:
    """E-23: a page and the count of all rows."""
    return page(df, limit, offset, *order), df.count()


def append_new(new: DataFrame, path: str, key: str) -> int:
    """K-2, K-3: appends rows whose content id the table lacks; returns how many."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    rows = new.dropDuplicates([key]) if old is None else new.dropDuplicates([key]).join(old, key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def record_decision(decisions: DataFrame, evaluation_id: str, label: str, reviewer: str, reason: str, supersedes: str | None) -> DataFrame:
    """X-9: the decision as a row to append; refused unless ``supersedes`` names the newest decision there is."""
    if label not in ("Match", "NonMatch", "Unsure"):
        raise ValueError("label must be Match, NonMatch or Unsure")
    row = latest(decisions.where(F.col("evaluation_id") == evaluation_id), "evaluation_id", "seq", "decision_id").first()
    if (row.decision_id if row else None) != supersedes:
        raise ValueError("a newer decision exists")
    seq = (row.seq if row else 0) + 1
    did = hashlib.sha256(f"{evaluation_id}\n{seq}\n{label}\n{reviewer}\n{reason}".encode()).hexdigest()
    return decisions.sparkSession.createDataFrame([(did, evaluation_id, label, reviewer, reason, seq, supersedes)], "decision_id string, evaluation_id string, human_label string, reviewer string, reason string, seq long, supersedes string")

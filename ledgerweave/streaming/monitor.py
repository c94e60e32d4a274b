"""Structured Streaming counterparts of the snapshot monitor (T-1..T-8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def monthly_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """T-6: event counts and sums per calendar month and type; months are group keys, as windows stop short of them."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.date_trunc("month", "ts").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def hourly_windows(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """T-3: one row per event id."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def churn_states(tokens: DataFrame) -> DataFrame:
    """T-5: running change counts per supplier over snapshots (supplier_id, snapshot_seq, token) as they arrive.

    State is the last snapshot, its token and the count; a gap or an empty token breaks the chain; rows older than the
    state are ignored, so a reopened snapshot changes nothing (T-4).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, token, changes = state.get if state.exists else (-1, "", 0)
        for part in parts:
            for r in part.sort_values("snapshot_seq").itertuples():
                if r.snapshot_seq <= seq:
                    continue
                changes += bool(r.token and token and r.snapshot_seq == seq + 1 and r.token != token)
                seq, token = int(r.snapshot_seq), r.token
        state.update((seq, token, changes))
        yield pd.DataFrame({"supplier_id": [key[0]], "snapshot_seq": [seq], "changes": [changes]})

    kind = tokens.schema["supplier_id"].dataType.simpleString()
    return tokens.groupBy("supplier_id").applyInPandasWithState(step, f"supplier_id {kind}, snapshot_seq long, changes long", "seq long, token string, changes long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """T-1: drains what is there now into a memory table; for tests and small monitors."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_latest(batch: DataFrame, batch_id: int, path: str, keys: tuple[str, ...] = ("supplier_id", "month", "currency")) -> None:
    """T-2: foreachBatch sink: the newest observation of each key so far, as a new version the pointer names last."""
    from ..sources.sinks import has_snapshot, read_snapshot, write_snapshot

    spark = batch.sparkSession
    seen = batch.unionByName(read_snapshot(spark, path, "observations")) if has_snapshot(spark, path) else batch
    rest = [c for c in batch.columns if c not in keys]
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "snapshot_seq").alias("r")).select(*keys, "r.*")
    write_snapshot({"observations": newest}, path)

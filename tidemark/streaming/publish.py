"""Streams of events into a store or a sketch cache."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tags import first_value
from ..model import ADDRESSABLE, COLUMNS, EVENT_SCHEMA, REPLACEABLE, kind_class, malformed
from ..operators.counts import author_sketches, merge_sketches
from ..sources.store import Store


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines, as files arrive."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path).where(~malformed())


def publish_stream(events: DataFrame, store: Store, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Publishes each micro-batch. Publishing twice is publishing once, so a batch that runs again does no harm."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.publish(batch))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def unique_stream(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each id once; with a delay, state for ids older than that is let go (and events of time 0 come too late)."""
    if delay is None:
        return events.dropDuplicates(["id"])
    return events.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"]).drop("at")


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: dict[str, Any] | None = dict(zip(("created_at", "id"), state.get)) if state.exists else None
    best = None
    for frame in frames:
        row = frame.sort_values(["created_at", "id"], ascending=[False, True]).iloc[0]
        if held is None or (row["created_at"], ) > (held["created_at"],) or (row["created_at"] == held["created_at"] and row["id"] < held["id"]):
            held, best = {"created_at": int(row["created_at"]), "id": row["id"]}, row
    if best is not None:
        state.update((held["created_at"], held["id"]))
        yield pd.DataFrame([best[list(COLUMNS)]])


def latest_stream(events: DataFrame) -> DataFrame:
    """Replaceable and addressable events that take the place of what was seen of their key, as they come."""
    rows = events.where(kind_class().isin(REPLACEABLE, ADDRESSABLE)).withColumn("d", F.when(kind_class() == ADDRESSABLE, first_value("d")).otherwise(F.lit("")))
    return rows.groupBy("pubkey", "kind", "d").applyInPandasWithState(_latest, EVENT_SCHEMA, "created_at long, id string", "append", GroupStateTimeout.NoTimeout)


def sketch_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps author sketches by kind and reference below ``path``, one directory for each micro-batch."""

    def fold(batch: DataFrame, number: int) -> None:
        author_sketches(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start()


def read_sketch_stream(spark: SparkSession, path: str) -> DataFrame:
    """The batches' sketches, merged."""
    return merge_sketches(spark.read.parquet(path).drop("batch"))

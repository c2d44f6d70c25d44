"""The history operators on a stream: latest per product, attempt states, exactly-once appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.history import LIFETIME, OUTCOMES
from ..operators.publish import append_snapshots

KEYS = ["user_id", "event_type"]


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive (a file alone is named by a pattern); times become instants, which event time asks for."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def latest(rows: DataFrame) -> DataFrame:
    """The last observation of each product by event time; an older one that arrives later changes nothing. For complete or
    update mode, one state row a product."""
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("last")).select(*KEYS, "last.*")


def windowed_counts(rows: DataFrame, late: str = "1 day", width: str = "6 hours") -> DataFrame:
    """Counts and sums by event-time window; what is later than `late` is dropped with its state."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, however often it is delivered within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def attempt_states(rows: DataFrame) -> DataFrame:
    """(user_id, state, since, event_id) after each batch that has news of a user: pending, stored, failed or empty by its last event in
    event time, kept as state between batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for batch in batches:
            top = batch.sort_values(["ts", "event_id"]).iloc[-1]
            seen = (int(top["ts"].value // 1000), int(top["event_id"]), str(top["event_type"]))
            if last is None or seen[:2] > tuple(last[:2]):
                last = seen
        state.update(last)
        yield pd.DataFrame({"user_id": [key[0]], "state": [OUTCOMES.get(last[2], "pending")], "since_us": [last[0]], "event_id": [last[1]]})

    return rows.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, state string, since_us long, event_id long", "since_us long, event_id long, kind string", "update", GroupStateTimeout.NoTimeout
    )


def usable(rows: DataFrame, as_of, lifetime: str = LIFETIME) -> DataFrame:
    """Rows that are fresh at `as_of`: the lifetime runs from event time against the clock, not against the watermark."""
    return rows.where((F.col("ts") <= as_of) & (F.col("ts") + F.expr(lifetime) > as_of))


def append_once(rows: DataFrame, folder: str, checkpoint: str):
    """Writes each batch to a folder of its own number, so a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_by_key(rows: DataFrame, folder: str, keys: list[str], digest: str, checkpoint: str):
    """Appends each batch's new keys to a ledger. A batch that is run again, or another stream that brings the same rows, changes nothing;
    a key that is stored with another digest stops the stream, and nothing of that batch is stored."""

    def write(batch: DataFrame, number: int) -> None:
        append_snapshots(batch, folder, keys, digest)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

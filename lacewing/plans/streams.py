"""Streaming queries, run over what is there now; each equals a batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_folder, table
from ..streaming import attempts, live
from .prices import SQL as PRICES


def _done(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """The rows that a stream gives in `mode` until its input is used up. Each batch is a stored table of its own, written anew if
    the batch is run again, and progress is kept beside them; in complete mode the last batch holds everything."""
    folder = fresh_folder(spark, "stream")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == query.lastProgress["batchId"])
    return rows.drop("batch")


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return live.event_stream(spark, f"{d}/events.parque[t]", rows.schema)


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return _done(live.latest(_events(spark, d)), "complete", spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = _done(live.attempt_states(_events(spark, d)), "update", spark)
    last = rows.groupBy("user_id").agg(F.max_by("state", F.struct("since_us", "event_id")).alias("state"), F.max("since_us").alias("since_us"))
    return last.select("user_id", "state", F.timestamp_micros("since_us").cast("timestamp_ntz").alias("since"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _done(live.windowed_counts(_events(spark, d)), "complete", spark)
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_attempt_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of all attempts. Every third event arrives three days late; arrivals come in files of eight days each, so that a file
    brings events older than those before it, and a last one closes the stream with a later time."""
    session, folder = attempts.with_state_store(spark), fresh_folder(spark, "arrivals")
    session.conf.set("spark.sql.shuffle.partitions", str(2 * spark.sparkContext.defaultParallelism))  # each part opens a store and a worker a batch
    rows = table(session, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    arrival = F.datediff("ts", F.lit("2024-01-01")) + F.when(F.col("event_id") % 3 == 0, 3).otherwise(0)
    last = rows.agg(F.max("ts").alias("ts"))
    for i in range(5):
        rows.where(F.least(F.floor(arrival / 8), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(folder)
    close = last.select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 60 days")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"))
    close.write.mode("append").parquet(folder)
    log = _done(attempts.attempt_events(live.event_stream(session, folder, rows.schema), "4 days"), "append", session)
    path = log.inputFiles()[0].rsplit("/batch=", 1)[0]
    return spark.read.schema(attempts.LOG).parquet(f"{path}/batch=*").select("user_id", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at"), "event_id", "action", "state")


QUERIES = {"stream_attempt_log": stream_attempt_log, "stream_latest": stream_latest, "stream_attempt_fsm": stream_attempts, "stream_windows": stream_windows}
SQL = {
    "stream_attempt_log": """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
        f as (select user_id, 0::bigint as rn, 'none' as state, null::timestamp as since, false as retried, null::timestamp as ts, null::bigint as event_id, null::varchar as action from events group by 1
          union all select user_id, rn, case action when 'begun' then 'pending' when 'applied' then case kind when 'purchase' then 'stored' when 'error' then 'failed' else 'empty' end else state end,
            case when action in ('begun', 'applied') then ts else since end, case action when 'begun' then false when 'retried' then true else retried end, ts, event_id, action
          from (select f.user_id, e.rn, f.state, f.since, f.retried, e.ts, e.event_id, e.event_type as kind, case
            when e.event_type = 'view' then case when f.state = 'pending' then 'rejected' when not f.retried and (f.state = 'failed' or (f.state = 'empty' and e.ts < f.since + interval 12 hour)) then 'blocked' else 'begun' end
            when e.event_type in ('purchase', 'error', 'signup') then case when f.state = 'pending' then 'applied' else 'rejected' end
            when e.event_type = 'click' and f.state in ('failed', 'empty') and not f.retried then 'retried' else 'ignored' end as action from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)),
        log as (select user_id, ts, event_id, action, state, rn from f where rn > 0),
        s as (select user_id, ts, lead(ts) over (partition by user_id order by rn) as following from log where action = 'applied' and state = 'stored'),
        x as (select user_id, ts + interval 12 hour as due from s where following is null or following >= ts + interval 12 hour)
        select user_id, ts as "at", event_id, action, state from log
        union all select x.user_id, x.due, null, 'expired', arg_max(l.state, l.rn) from x join log l on l.user_id = x.user_id and l.ts < x.due group by x.user_id, x.due""",
    "stream_latest": PRICES["latest_per_product"],
    "stream_attempt_fsm": f"select user_id, state, since from ({PRICES['attempt_state']})",
    "stream_windows": "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as begins, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}

"""Queries over tables that are changed by commits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources.tables import fresh_folder, moment, table

AT = "2024-03-01 00:00:00"


def _captures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A capture is a user's day; the events of it are what it observed."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("observed_at"), F.col("event_id").alias("product_id"), F.col("value").alias("price"))
    whole = rows.groupBy(*L.KEY).agg(F.count("*").alias("n"), F.sum("product_id").alias("sum"))
    return whole.select(*L.KEY, F.sha2(F.concat_ws(":", "n", "sum"), 256).alias("digest")), rows


def _imported(spark: SparkSession, d: str) -> L.Ledger:
    """Three batches: the days up to the 20th, those from the 11th on, of which a third is there already, and the first again."""
    ledger = L.Ledger(spark, fresh_folder(spark, "ledger"), L.TABLES)
    snapshots, observations = _captures(spark, d)
    day = F.dayofmonth("observed_at")
    for part in (day <= 20, day > 10, day <= 20):
        L.import_snapshots(ledger, snapshots.where(part), observations.where(part))
    return ledger


def committed_imports(spark: SparkSession, d: str) -> DataFrame:
    ledger = _imported(spark, d)
    seen = ledger.head()
    sizes = ledger.read("observations", seen).groupBy("snapshot_id").agg(F.count("*").alias("products"))
    return ledger.read("snapshots", seen).join(sizes, "snapshot_id").select("snapshot_id", "source", "observed_at", "products", F.lit(seen.number).alias("version"))


def pinned_prices(spark: SparkSession, d: str) -> DataFrame:
    """Latest prices as of the first version, read after the last one is made."""
    ledger = _imported(spark, d)
    seen = ledger.at(1)
    rows = ledger.read("observations", seen).join(ledger.read("snapshots", seen), "snapshot_id")
    return rows.groupBy("source").agg(F.max("snapshot_id").alias("revision"), F.max("observed_at").alias("last"), F.count("*").alias("observations"))


def committed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """An attempt for each user and kind of event; those of an even number of events end empty, of the rest those of a multiple of
    three fail, and are asked for again."""
    ledger = L.Ledger(spark, fresh_folder(spark, "ledger"), L.TABLES)
    counts = table(spark, d, "events").groupBy(F.concat_ws(":", "user_id", "event_type").alias("key")).agg(F.count("*").alias("n"))
    at = moment(AT)
    seen, _ = L.begin_attempts(ledger, counts.select("key"), at)
    begun = ledger.read("attempts", seen).select("attempt_id", "key").join(counts, "key")
    outcome = F.when(F.col("n") % 2 == 0, "empty").when(F.col("n") % 3 == 0, "failed")
    ends = begun.select("attempt_id", outcome.alias("outcome"), F.concat(F.lit("after "), F.col("n").cast("string")).alias("error")).where("outcome is not null")
    seen, _ = L.finish_attempts(ledger, ends, at + F.expr("interval 1 hour"))
    failed = L.latest_attempts(ledger, seen).where("outcome = 'failed'")
    seen, _ = L.begin_attempts(ledger, failed.select("key"), at + F.expr("interval 2 hours"))
    return L.latest_attempts(ledger, seen).select("key", "attempt_id", "outcome", "at", "products", "error")


QUERIES = {"committed_imports": committed_imports, "pinned_prices": pinned_prices, "committed_attempts": committed_attempts}
CAPTURED = """captured as (select user_id::varchar as source, date_trunc('day', ts)::timestamp as observed_at, count(*) as products from events group by all),
    ids as (select *, row_number() over (order by day(observed_at) > 20, observed_at, source) as snapshot_id from captured)"""
SQL = {
    "committed_imports": f"with {CAPTURED} select snapshot_id, source, observed_at, products, 2 as version from ids",
    "pinned_prices": f"with {CAPTURED} select source, max(snapshot_id) as revision, max(observed_at) as last, sum(products)::bigint as observations from ids where day(observed_at) <= 20 group by source",
    "committed_attempts": f"""with c as (select user_id || ':' || event_type as key, count(*) as n from events group by 1), b as (select *, row_number() over (order by key) as id, count(*) over () as total from c),
        s as (select *, case when n % 2 = 0 then 'empty' when n % 3 = 0 then 'failed' else 'pending' end as o from b), r as (select key, row_number() over (order by key) as again from s where o = 'failed')
        select key, coalesce(total + again, id) as attempt_id, case when o = 'failed' then 'pending' else o end as outcome,
          timestamp '{AT}' + case o when 'empty' then interval 1 hour when 'failed' then interval 2 hour else interval 0 hour end as at, case when o = 'empty' then 0 end::bigint as products, null::varchar as error from s left join r using (key)""",
}

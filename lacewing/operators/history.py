"""Observation history: latest per key, freshness, attempt states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long an observation is usable. It counts from the event, never from its arrival, and is never extended.
LIFETIME = "INTERVAL 12 HOURS"


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The row of each key that is last by `order`; `where` is applied before the pick, so it bounds the history. One
    partial maximum, no sort of whole rows."""
    rows = rows if where is None else rows.where(where)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def revision(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(sequence).alias("revision"))


def age_status(last: Column, as_of: Column, lifetime: str = LIFETIME) -> Column:
    """Strictly later than as_of is future, and exactly one lifetime old is expired."""
    return F.when(last > as_of, "future").when(last + F.expr(lifetime) <= as_of, "expired").otherwise("fresh")


def freshness(rows: DataFrame, keys: list[str], time: str, as_of: Column, lifetime: str = LIFETIME) -> DataFrame:
    """Per key: its status by its last observation, and whether each of its observations is fresh (one stale member fails the group)."""
    return rows.groupBy(*keys).agg(F.max(time).alias("last"), F.min(time).alias("first")).select(*keys, "last", age_status(F.col("last"), as_of, lifetime).alias("status"), (age_status(F.col("first"), as_of, lifetime) == "fresh").alias("all_fresh"))


def group_expiry(rows: DataFrame, keys: list[str], time: str, lifetime: str = LIFETIME) -> DataFrame:
    """A group is usable until the first of its members expires."""
    return rows.groupBy(*keys).agg((F.min(time) + F.expr(lifetime)).alias("expires_at"), F.count("*").alias("members"))


OUTCOMES = {"purchase": "stored", "error": "failed", "signup": "empty"}


def outcome(kind: Column) -> Column:
    """A transition's outcome; all others leave an attempt pending."""
    out = None
    for name, value in OUTCOMES.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise("pending")


def attempt_gate(rows: DataFrame, key: str, time: str, sequence: str, kind: str, as_of: Column) -> DataFrame:
    """The state of each key's last attempt, and whether a new request may go out: a failure blocks at any age, an empty
    answer for a lifetime."""
    last = latest_per_key(rows.select(key, time, sequence, kind), [key], [time, sequence])
    state = outcome(F.col(kind))
    allowed = (state != "failed") & ~((state == "empty") & (F.col(time) + F.expr(LIFETIME) > as_of))
    return last.select(key, state.alias("state"), F.col(time).alias("since"), allowed.alias("request_allowed"))


def work_list(wanted: DataFrame, seen: DataFrame, known: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Keys of `wanted` that `seen` lacks, those with an older observation in `known` first, then by key."""
    missing = wanted.join(seen.select(*keys).distinct(), keys, "left_anti")
    old = known.groupBy(*keys).agg(F.max(time).alias("last"))
    return missing.join(old, keys, "left").select(*keys, F.when(F.col("last").isNotNull(), 0).otherwise(1).alias("priority"), "last")


def append_new(batch: DataFrame, stored: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Each row of a batch with what an import does: `new`, `unchanged` (same key and digest), or `conflict`."""
    known = stored.select(*keys, F.col(digest).alias("known"))
    action = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col(digest), "unchanged").otherwise("conflict")
    return batch.join(known, keys, "left").withColumn("action", action).drop("known")


def islands(rows: DataFrame, key: str, time: str, sequence: str, starts: Column) -> DataFrame:
    """Rows numbered by island; `starts` says where one begins, from `gap`, the microseconds since the row before (null at
    the first) and `usual`, the key's median gap."""
    order = Window.partitionBy(key).orderBy(time, sequence)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gaps = rows.withColumn("gap", micros - F.lag(micros).over(order))
    gaps = gaps.withColumn("usual", F.median("gap").over(Window.partitionBy(key)))
    return gaps.withColumn("island", F.sum(F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def attempt_log(rows: DataFrame, attempt: list[str], time: str, sequence: str, kind: str, begins: str) -> DataFrame:
    """The log's rows with what each does: `begun` (the first row of kind `begins`), `applied` (the first outcome after it, which ends
    the attempt), or `rejected`: an attempt changes state once, and only while it is pending."""
    at = F.struct(time, sequence)
    first = rows.where(F.col(kind) == begins).groupBy(*attempt).agg(F.min(at).alias("begun"))
    known = rows.join(first, attempt, "left")
    ending = known.where(F.col(kind).isin(*OUTCOMES) & (at > F.col("begun")))
    ends = ending.groupBy(*attempt).agg(F.min(at).alias("ended"))
    action = F.when(at == F.col("begun"), "begun").when(at == F.col("ended"), "applied").otherwise("rejected")
    return known.join(ends, attempt, "left").withColumn("action", action).drop("begun", "ended")


def retry_gate(rows: DataFrame, key: str, time: str, sequence: str, kind: str, retry: str, as_of: Column) -> DataFrame:
    """Per key: its last outcome, and whether a request may go out. A failure stays until a `retry` later than it, which also lifts
    the wait after an empty answer; a key without any outcome may be asked for."""
    at = F.struct(time, sequence)
    last = rows.groupBy(key).agg(F.max_by(kind, F.when(F.col(kind).isin(*OUTCOMES), at)).alias("kind"), F.max(F.when(F.col(kind).isin(*OUTCOMES), at)).alias("at"), F.max(F.when(F.col(kind) == retry, at)).alias("retried"))
    state = F.when(F.col("at").isNull(), "none").otherwise(outcome(F.col("kind")))
    blocked = (state == "failed") | ((state == "empty") & (F.col(f"at.{time}") + F.expr(LIFETIME) > as_of))
    return last.select(key, state.alias("state"), F.coalesce(F.col("retried") > F.col("at"), F.lit(False)).alias("retried"), blocked.alias("blocked")).withColumn("request_allowed", ~F.col("blocked") | F.col("retried")).drop("blocked")


def bounded_observations(rows: DataFrame, snapshots: DataFrame, snapshot: str, keys: list[str], last: Column) -> DataFrame:
    """Each key's row of the latest snapshot no later than `last`, with that snapshot's columns; `last` is in terms of the snapshots, so
    those beyond it drop out before the join."""
    seen = rows.join(snapshots.where(last), snapshot)
    rest = [c for c in seen.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(snapshot, *[c for c in rows.columns if c not in (snapshot, *keys)])).alias("last")).select(*keys, "last.*")


def reusable(checkpoints: DataFrame, current: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Each current key and whether its checkpoint may be used again: only if all of its identity, by digest, is as it was."""
    digest = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    old = checkpoints.select(key, digest.alias("old"))
    return current.select(key, digest.alias("new")).join(old, key, "left").select(key, F.when(F.col("old").isNull(), "missing").when(F.col("old") == F.col("new"), "valid").otherwise("stale").alias("checkpoint"))


def unusable(wanted: DataFrame, observations: DataFrame, keys: list[str], time: str, as_of: Column, lifetime: str = LIFETIME) -> DataFrame:
    """Of each wanted key why its price can't be used: `never stored`, `future` or `expired` by its last observation, or null. `turn` is the order
    in which they are collected: expired before never stored, then by key; null for the rest."""
    last = observations.groupBy(*keys).agg(F.max(time).alias("last"))
    why = F.when(F.col("last").isNull(), "never stored").otherwise(F.nullif(age_status(F.col("last"), as_of, lifetime), F.lit("fresh")))
    return wanted.select(*keys).distinct().join(last, keys, "left").select(*keys, "last", why.alias("why")).withColumn("turn", F.when(F.col("why") == "expired", 0).when(F.col("why") == "never stored", 1))


def resumed(wanted: DataFrame, checkpoints: DataFrame, key: str, identity: list[str], fault: Column) -> DataFrame:
    """Each wanted key with what a resumed crawl does: `reuse` its checkpoint, `fetch` what has none or one of another identity, or stop at one that
    is `broken`, since a checkpoint that is there is never silently fetched anew. `fault` is null for a sound checkpoint; a key with
    several checkpoints is broken."""
    held = checkpoints.select(key, F.struct(*identity).alias("old"), fault.alias("fault")).groupBy(key).agg(F.count("*").alias("n"), F.min("old").alias("old"), F.max("fault").alias("fault"))
    action = F.when(F.col("n").isNull(), "fetch").when((F.col("n") > 1) | F.col("fault").isNotNull(), "broken").when(F.col("old").eqNullSafe(F.struct(*identity)), "reuse").otherwise("fetch")
    return wanted.join(held, key, "left").select(key, action.alias("action"), F.col("fault").alias("fault"))

"""Collection attempts as state of a stream: guarded transitions, sticky failures, and prices that expire by event time.

Events wait as state until the watermark has passed them, so they count in the order of their own time, whatever the order of
arrival. One timer a key, at the next moment that matters to it, brings it back when nothing new arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import OUTCOMES

#: In microseconds: how long a stored price is usable, and how long an empty answer holds off a request. It counts from the event.
LIFETIME_US = 12 * 3600 * 1_000_000
REQUEST, RETRY = "view", "click"
LOG = "user_id long, at_us long, event_id long, action string, state string"


@dataclass
class Attempt:
    """A key's attempt (none, pending, stored, failed, empty), when it came to that, whether a retry was asked for since, and when its
    price expires (0: none)."""

    state: str = "none"
    since: int = 0
    retried: bool = False
    expires: int = 0

    SCHEMA = "state string, since long, retried boolean, expires long"

    def expired(self, now: int) -> list[tuple[int, int | None, str, str]]:
        """The expiry, if it is due: exactly one lifetime after the last price was stored."""
        if not self.expires or self.expires > now:
            return []
        at, self.expires = self.expires, 0
        return [(at, None, "expired", self.state)]

    def apply(self, at: int, event: int, kind: str) -> list[tuple[int, int | None, str, str]]:
        """What an event does: a request begins an attempt unless one is pending, a failure has not been retried, or an empty answer is
        younger than a lifetime; an outcome ends a pending attempt, once; a retry lifts a failure or an empty answer."""
        out = self.expired(at)
        if kind == REQUEST:
            waits = self.state == "failed" or (self.state == "empty" and at < self.since + LIFETIME_US)
            action = "rejected" if self.state == "pending" else "blocked" if waits and not self.retried else "begun"
            if action == "begun":
                self.state, self.since, self.retried = "pending", at, False
        elif kind in OUTCOMES:
            action = "applied" if self.state == "pending" else "rejected"
            if action == "applied":
                self.state, self.since = OUTCOMES[kind], at
                if self.state == "stored":
                    self.expires = at + LIFETIME_US
        elif kind == RETRY and self.state in ("failed", "empty") and not self.retried:
            action, self.retried = "retried", True
        else:
            action = "ignored"
        return [*out, (at, event, action, self.state)]


class Attempts(StatefulProcessor):
    """Gives a row of the log for each event and expiry that the watermark has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempt = handle.getValueState("attempt", Attempt.SCHEMA)
        self.waiting = handle.getListState("waiting", "at_us long, event_id long, kind string")
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at_us, r.event_id, r.event_type) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(at for at, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        attempt = Attempt(*self.attempt.get()) if self.attempt.exists() else Attempt()
        events = sorted(tuple(x) for x in self.waiting.get())
        due = [e for e in events if e[0] <= now]
        log = [row for e in due for row in attempt.apply(*e)] + attempt.expired(now)
        rest = events[len(due) :]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if log:
            self.attempt.update(astuple(attempt))
        self.timer.clear()
        following = [at for at in (rest[0][0] if rest else 0, attempt.expires) if at]
        if following:
            self._wake(min(following))
        return (Row(user_id=key[0], at_us=at, event_id=event, action=action, state=state) for at, event, action, state in log)

    def _wake(self, at_us: int) -> None:
        """One timer, at the earliest moment asked for."""
        at_ms = -(-at_us // 1000)
        if self.timer.exists():
            known = self.timer.get()[0]
            if known <= at_ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def close(self) -> None:
        pass


def attempt_events(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """The log (user_id, at_us, event_id, action, state) of a stream of events (user_id, ts, event_id, event_type), for append mode. An
    event later than `late` behind the newest is dropped. The state of a key is its attempt and the events that wait; needs the
    RocksDB state store (`with_state_store`)."""
    events = rows.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts")).select("user_id", "ts", "at_us", "event_id", "event_type")
    return events.groupBy("user_id").transformWithState(statefulProcessor=Attempts(), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_state_store(spark):
    """A session beside `spark` whose streams keep their state in RocksDB, whose changes are kept in the checkpoint."""
    session = spark.newSession()
    for k, v in STORE.items():
        session.conf.set(k, v)
    return session

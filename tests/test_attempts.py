import random
import time
from datetime import datetime, timedelta

import pytest

from lacewing.operators import publish
from lacewing.streaming import attempts, live

HOUR = 3600 * 1_000_000
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"
START = datetime(2024, 1, 1)


def log(events):
    """events: (hours, kind); what each does, by itself."""
    a, out = attempts.Attempt(), []
    for i, (hours, kind) in enumerate(events):
        out += [(at / HOUR, event, action, state) for at, event, action, state in a.apply(int(hours * HOUR), i, kind)]
    return [(x[2], x[3]) for x in out]


def test_an_attempt_ends_once():
    assert log([(0, "purchase"), (1, "view"), (2, "view"), (3, "purchase"), (4, "error")]) == [("rejected", "none"), ("begun", "pending"), ("rejected", "pending"), ("applied", "stored"), ("rejected", "stored")]


def test_a_failure_sticks_until_a_retry():
    assert log([(0, "view"), (1, "error"), (999, "view"), (1000, "click"), (1001, "click"), (1002, "view"), (1003, "click")]) == [
        ("begun", "pending"), ("applied", "failed"), ("blocked", "failed"), ("retried", "failed"), ("ignored", "failed"), ("begun", "pending"), ("ignored", "pending")
    ]


def test_an_empty_answer_holds_off_for_a_lifetime():
    assert log([(0, "view"), (1, "signup"), (12.999, "view"), (13, "view")])[-2:] == [("blocked", "empty"), ("begun", "pending")]
    assert log([(0, "view"), (1, "signup"), (2, "click"), (3, "view")])[-1] == ("begun", "pending")


def test_a_price_expires_at_a_fixed_time():
    assert log([(0, "view"), (1, "purchase"), (5, "view"), (13, "add")]) == [("begun", "pending"), ("applied", "stored"), ("begun", "pending"), ("expired", "pending"), ("ignored", "pending")]
    assert [x for x, _ in log([(0, "view"), (1, "purchase"), (5, "view"), (6, "purchase"), (17.9, "add"), (18, "add")])].index("expired") == 5


def plain(rows, until):
    out = []
    for user in sorted({r[0] for r in rows}):
        a = attempts.Attempt()
        for u, ts, event, kind in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            out += [(u, *x) for x in a.apply(micros(ts), event, kind)]
        out += [(user, *x) for x in a.expired(micros(until))]
    return sorted(out, key=repr)


def micros(ts):
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def run(spark, folder, session):
    """What is there by now, through the stream; each batch a folder that a second run of it replaces."""
    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream = attempts.attempt_events(live.event_stream(session, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema), "2 days")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r)[:5] for r in spark.read.schema(attempts.LOG).parquet(f"{folder}/out/batch=*").collect()), key=repr)


def test_the_stream_is_the_fold_and_survives_a_restart(spark, tmp_path):
    rng, folder, rows = random.Random(4), str(tmp_path), []
    for i in range(300):
        hours = rng.uniform(0, 200)
        rows.append((rng.choice([1, 1, 1, 2, 3]), START + timedelta(hours=round(hours, 4)), i, rng.choice(["view", "view", "purchase", "error", "signup", "click", "add"])))
    arrival = {r[2]: (r[1] - START) / timedelta(hours=1) + rng.choice([0, 0, 30]) for r in rows}
    end = START + timedelta(days=60)
    session = attempts.with_state_store(spark)
    files = [[r for r in rows if a <= arrival[r[2]] < a + 60] for a in range(0, 240, 60)] + [[(-1, end, -1, "end")]]
    want = plain(rows, end - timedelta(days=2))
    for k, file in enumerate(files):
        spark.createDataFrame(file, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
        if k in (1, 2, 4):  # the stream stops between, and goes on where it was
            got = run(spark, folder, session)
            assert set(got) <= set(want)
        if k == 2:  # the last batch's end is lost, so that it runs again
            commits = sorted((int(p.name) for p in (tmp_path / "progress" / "commits").iterdir() if p.name.isdigit()))
            for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
                (tmp_path / "progress" / "commits" / name).unlink(missing_ok=True)
            assert run(spark, folder, session) == got
    assert got == want and {x[3] for x in got} == {"begun", "applied", "rejected", "blocked", "retried", "ignored", "expired"}


def test_a_stream_appends_each_key_once(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    schema = "k long, digest string, n int"
    for i, rows in enumerate([[(1, "a", 1), (1, "a", 1), (2, "b", 2)], [(2, "b", 2), (3, "c", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    stream = lambda i, name: live.append_by_key(spark.readStream.schema(schema).parquet(f"{tmp_path}/in{i}"), folder, ["k"], "digest", f"{tmp_path}/{name}")
    for i, name in ((0, "p0"), (0, "again"), (1, "p1")):
        stream(i, name).awaitTermination()
    assert sorted(r.k for r in publish.current(spark, folder, "rows").collect()) == [1, 2, 3] and publish.published(spark, folder).number == 2
    spark.createDataFrame([(3, "other", 3), (4, "d", 4)], schema).write.parquet(f"{tmp_path}/in2")
    with pytest.raises(Exception, match="another digest"):
        stream(2, "p2").awaitTermination()
    assert publish.current(spark, folder, "rows").count() == 3

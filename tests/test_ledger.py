import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacewing.operators import ledger as L
from lacewing.operators import publish

DAY = datetime(2024, 1, 1)
def at():
    return F.lit(DAY).cast("timestamp_ntz")



@pytest.fixture
def db(spark, tmp_path):
    return L.Ledger(spark, f"file://{tmp_path}/db", L.TABLES)


def batch(spark, rows, attempts=None):
    """rows: (source, hours, digest, prices of products 1, 2, ...)"""
    snapshots = [(s, DAY + timedelta(hours=h), x, *([attempts.get(s)] if attempts else [])) for s, h, x, _ in rows]
    observations = [(s, DAY + timedelta(hours=h), i, float(p)) for s, h, _, prices in rows for i, p in enumerate(prices, 1)]
    return (
        spark.createDataFrame(snapshots, "source string, observed_at timestamp_ntz, digest string" + ", attempt_id long" * bool(attempts)),
        spark.createDataFrame(observations, "source string, observed_at timestamp_ntz, product_id long, price double"),
    )


def states(db):
    return {r.key: (r.attempt_id, r.outcome, r.snapshot_id, r.products, r.error) for r in L.latest_attempts(db, db.head()).collect()}


def test_a_snapshot_goes_in_once(spark, db):
    one = batch(spark, [("u", 0, "x", [5, 6]), ("v", 0, "y", [7]), ("u", 0, "x", [5, 6])])
    made, told = L.import_snapshots(db, *one)
    assert told == {"inserted": 2, "unchanged": 0} and made.number == 1
    again, told = L.import_snapshots(db, *one)
    assert told == {"inserted": 0, "unchanged": 2} and again == made
    for wrong in ([("u", 0, "z", [5])], [("n", 0, "x", [5]), ("n", 0, "y", [5])], [("w", 0, "x", [])], [("w", 1, "x", [1]), ("u", 0, "z", [5])]):
        with pytest.raises(L.Refused):
            L.import_snapshots(db, *batch(spark, wrong))
    assert db.head() == made and db.read("observations", made).count() == 3


def test_an_older_capture_that_comes_late_changes_no_price(spark, db):
    L.import_snapshots(db, *batch(spark, [("u", 5, "x", [50])]))
    seen, _ = L.import_snapshots(db, *batch(spark, [("u", 1, "y", [10]), ("u", 6, "z", [60, 61])]))
    assert {(r.product_id, r.price, r.snapshot_id) for r in L.current_prices(db, seen).collect()} == {(1, 60.0, 3), (2, 61.0, 3)}
    assert {(r.product_id, r.price) for r in L.current_prices(db, db.at(1)).collect()} == {(1, 50.0)}


def test_attempts_end_once_and_with_their_snapshot(spark, db):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    _, first = L.begin_attempts(db, keys, at())
    assert first == 1 and states(db) == {k: (i, "pending", None, None, None) for i, k in enumerate("abc", 1)}
    ends = spark.createDataFrame([(1, "failed", "no answer"), (2, "empty", "x")], "attempt_id long, outcome string, error string")
    assert L.finish_attempts(db, ends, at())[1] == 2
    got = batch(spark, [("u", 0, "x", [5, 6])], {"u": 3})
    L.import_snapshots(db, *got, at=at())
    assert states(db) == {"a": (1, "failed", None, None, "no answer"), "b": (2, "empty", None, 0, None), "c": (3, "stored", 1, 2, None)}
    seen = db.head()
    for wrong in ([(1, "empty", "")], [(9, "empty", "")], [(3, "failed", "")], [(1, "stored", "")]):
        with pytest.raises(L.Refused):
            L.finish_attempts(db, spark.createDataFrame(wrong, ends.schema), at())
    L.begin_attempts(db, keys.limit(1), at())
    for rows, ids in (([("u", 0, "x", [5, 6])], {"u": 4}), ([("w", 0, "x", [5])], {"w": 1}), ([("w", 0, "x", [5]), ("w", 1, "x", [5])], {"w": 4})):
        with pytest.raises(L.Refused):
            L.import_snapshots(db, *batch(spark, rows, ids), at=at())
    assert db.head().number == seen.number + 1 and states(db)["a"][:2] == (4, "pending")


def test_writers_at_once(spark, db):
    shared, results, errors = batch(spark, [("s", 0, "x", [1])]), [], []

    def run(i):
        try:
            results.append(L.import_snapshots(db, *batch(spark, [(f"w{i}", 0, "x", [1, 2]), (f"w{i}", 1, "y", [3])]))[1])
            results.append(L.import_snapshots(db, *shared)[1])
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sum(r["inserted"] for r in results) == 9 and sum(r["unchanged"] for r in results) == 3
    seen = db.head()
    ids = [r.snapshot_id for r in db.read("snapshots", seen).collect()]
    assert sorted(ids) == list(range(1, 10)) and db.numbers() == list(range(1, seen.number + 1)) == list(range(1, 6))
    assert db.read("observations", seen).count() == 13
    for n in db.numbers():  # ids are committed in ascending order
        assert sorted(r.snapshot_id for r in db.read("snapshots", db.at(n)).collect()) == list(range(1, db.at(n).last_ids["snapshots"] + 1))


def test_a_number_is_made_once(spark, tmp_path):
    path, made = f"file://{tmp_path}/x/1.json", []
    threads = [threading.Thread(target=lambda i=i: made.append((L.create_once(spark, path, str(i)), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [i for ok, i in made if ok]
    assert len(made) == 8 and len(winners) == 1
    assert (tmp_path / "x" / "1.json").read_text() == str(winners[0]) and len(list((tmp_path / "x").iterdir())) == 1


def test_a_writer_that_stops_before_its_record_leaves_no_trace(spark, db, monkeypatch):
    L.import_snapshots(db, *batch(spark, [("u", 0, "x", [1])]))
    seen = db.head()

    def stop(*_):
        raise OSError("gone")

    monkeypatch.setattr(L, "create_once", stop)
    with pytest.raises(OSError):
        L.import_snapshots(db, *batch(spark, [("v", 0, "x", [1])]))
    monkeypatch.undo()
    assert db.head() == seen and len(db.unnamed()) == 2
    assert L.import_snapshots(db, *batch(spark, [("v", 0, "x", [1])]))[1] == {"inserted": 1, "unchanged": 0}
    assert sorted(r.snapshot_id for r in db.read("snapshots", db.head()).collect()) == [1, 2]


def test_a_reader_keeps_its_version_of_all_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/pub"
    publish.publish({"cards": spark.range(3), "names": spark.range(3)}, {}, folder)
    seen = publish.published(spark, folder)
    publish.publish({"cards": spark.range(5), "names": spark.range(5)}, {}, folder)
    assert [publish.current(spark, folder, t, seen).count() for t in ("cards", "names")] == [3, 3]
    assert [publish.current(spark, folder, t).count() for t in ("cards", "names")] == [5, 5]


def test_a_key_twice_in_a_batch_is_appended_once(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([("u", 1, "x", 5), ("u", 1, "x", 5), ("v", 1, "y", 6)], "url string, at int, sha string, n int")
    assert publish.append_snapshots(df, folder, ["url", "at"], "sha") == {"inserted": 2, "unchanged": 0}
    with pytest.raises(ValueError):
        publish.append_snapshots(spark.createDataFrame([("w", 1, "x", 1), ("w", 1, "z", 1)], df.schema), folder, ["url", "at"], "sha")

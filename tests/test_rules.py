"""Boundary rows of the rules, on small literal frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacewing.functions import scalars
from lacewing.operators import deck, history, identity, matching, pricing, quality, suppression
from lacewing.sources.tables import moment

NOW = datetime(2026, 1, 1, 12)
HOUR = timedelta(hours=1)


def test_age_is_inclusive_for_expiry_and_strict_for_future(spark):
    rows = [("exact", NOW - 12 * HOUR), ("young", NOW - 12 * HOUR + timedelta(microseconds=1)), ("now", NOW), ("later", NOW + timedelta(microseconds=1))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    got = {r.k: r.s for r in df.select("k", history.age_status(F.col("t"), moment(NOW)).alias("s")).collect()}
    assert got == {"exact": "expired", "young": "fresh", "now": "fresh", "later": "future"}


def test_one_stale_member_fails_the_group(spark):
    df = spark.createDataFrame([("a", NOW), ("a", NOW - 13 * HOUR), ("b", NOW)], "k string, t timestamp_ntz")
    assert {r.k: r.all_fresh for r in history.freshness(df, ["k"], "t", moment(NOW)).collect()} == {"a": False, "b": True}


def test_older_capture_that_arrives_later_replaces_nothing(spark):
    df = spark.createDataFrame([("p", 2, NOW - HOUR, 10), ("p", 1, NOW, 20)], "k string, id long, t timestamp_ntz, v int")
    assert history.latest_per_key(df, ["k"], ["t", "id"]).first().v == 20


def test_bound_comes_before_the_pick(spark):
    df = spark.createDataFrame([("p", 1, 10), ("p", 2, 20), ("p", 3, 30)], "k string, id long, v int")
    assert history.latest_per_key(df, ["k"], ["id"], F.col("id") <= 2).first().v == 20


def test_attempt_gate(spark):
    df = spark.createDataFrame([(1, NOW - 100 * HOUR, 1, "error"), (2, NOW - HOUR, 2, "signup"), (3, NOW - 12 * HOUR, 3, "signup"), (4, NOW, 4, "view"), (4, NOW - HOUR, 5, "error")], "u long, t timestamp_ntz, id long, kind string")
    got = {r.u: (r.state, r.request_allowed) for r in history.attempt_gate(df, "u", "t", "id", "kind", moment(NOW)).collect()}
    assert got == {1: ("failed", False), 2: ("empty", False), 3: ("empty", True), 4: ("pending", True)}


def test_import_twice_and_with_another_hash(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "k long, h string")
    batch = spark.createDataFrame([(1, "x"), (2, "z"), (3, "q")], "k long, h string")
    assert {r.k: r.action for r in history.append_new(batch, stored, ["k"], "h").collect()} == {1: "unchanged", 2: "conflict", 3: "new"}


PRINTS = [(1, "ja", "N1", 1), (1, "ja", "N1", 3), (1, "ja", "N2", 3), (1, "ja", "N2", 4), (1, "ja", "N3", 9)]


def prices(spark, listings):
    prints = spark.createDataFrame(PRINTS, "part long, edition string, number string, rid int")
    rows = spark.createDataFrame([(1, "ja", *x) for x in listings], "part long, edition string, number string, product long, price long, stock string, label string, observed timestamp_ntz")
    return {r.rid: r for r in pricing.select_prices(prints, rows, moment(NOW), "INTERVAL 12 HOURS").collect()}


def test_prices(spark):
    rows = [("N1", 9, 100, "in_stock", "1-URGENT", NOW), ("N1", 10, 100, "in_stock", "1-URGENT", NOW), ("N1", 3, 1, "out_of_stock", "1-URGENT", NOW), ("N1", 4, 7, "unknown", "3-MEDIUM", NOW), ("N2", 5, 2, "in_stock", "3-MEDIUM", NOW)]
    got = prices(spark, rows)
    assert (got[1].status, got[1].price, got[1].matched, got[1].in_stock) == ("ok", 100, 3, 2)
    assert (got[3].status, got[3].price, got[3].unverified) == ("stock_unknown", 7, 1)  # at N2 the label may mean 3 or 4
    assert (got[4].status, got[4].price) == ("unverified", None)
    assert (got[9].status, got[9].price, got[9].expires) == ("not_observed", None, None)


def test_a_stale_number_decides_over_the_cheaper_rest(spark):
    rows = [("N1", 1, 5, "in_stock", "3-MEDIUM", NOW), ("N2", 2, 50, "in_stock", "2-HIGH", NOW - 12 * HOUR)]
    got = prices(spark, rows)
    assert got[3].status == "expired" and got[3].price is None and got[1].status == "not_observed"
    assert prices(spark, [("N1", 1, 5, "in_stock", "1-URGENT", NOW + HOUR)])[1].status == "data_error"


def test_deck_order_ties(spark):
    rows = [(1, 7, -1, None), (2, 7, 0, 5), (3, 8, 0, None), (4, 7, 0, None), (5, 7, 0, 4)]
    df = spark.createDataFrame(rows, "cid long, level int, stat int, pass int")
    out = deck.deck_order(df, F.lit(1), F.col("level"), F.col("stat"), F.col("pass"), F.col("cid"))
    assert [r.cid for r in out.orderBy("place").collect()] == [3, 5, 2, 4, 1]


def test_columns_come_in_canonical_order(spark):
    names = deck.COLUMNS
    for bits in range(1, 2 ** len(names)):
        chosen = {c for i, c in enumerate(names) if bits >> i & 1}
        assert deck.selected(chosen) == [c for c in names if c in chosen]
    with pytest.raises(ValueError):
        deck.selected({"nothing"})


def test_conflicts_treat_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (2, "a")], "k long, v string")
    assert [r.k for r in deck.conflicts(df, ["k"], ["v"]).collect()] == [2]


def test_locale_union_and_blank_names(spark):
    ko = spark.createDataFrame([(1, ""), (2, "b")], "cid long, name string")
    ja = spark.createDataFrame([(1, "x"), (3, "c")], "cid long, name string")
    assert {r.cid: r.display for r in identity.locale_union({"ko": ko, "ja": ja}, "cid").collect()} == {1: "x", 2: "b", 3: "c"}


def test_an_unplaced_record_leaves_all_absent_cards_open(spark):
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "card long, name string")
    records = spark.createDataFrame([(10, 1, "a"), (11, None, "b")], "record long, direct long, name string")
    placed = identity.place_records(records, cards)
    assert {r.record: (r.card, r.method) for r in placed.collect()} == {10: (1, "direct"), 11: (None, "unplaced")}
    assert {r.card: r.status for r in identity.support_status(cards, placed).collect()} == {1: "supported", 2: "unresolved", 3: "unresolved"}
    assert {r.card: r.status for r in identity.support_status(cards, placed.where("record = 10")).collect()}[2] == "unsupported"


def test_gate_holds_back_the_whole_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2), ("c", None)], "g string, v int")
    bad = quality.violations(df, ["g"], {"positive": F.col("v") > 0})
    assert [r.g for r in quality.publishable(df, bad, ["g"]).collect()] == ["b"]


def test_scalars(spark):
    df = spark.createDataFrame([("?", "1,234"), ("-", "12,34"), ("0", "5"), ("x", None)], "s string, m string")
    assert [r[0] for r in df.select(scalars.stat_value(F.col("s"))).collect()] == [-1, 0, 0, None]
    assert [r[0] for r in df.select(scalars.money_value(F.col("m"))).collect()] == [1234, None, 5, None]
    one = spark.createDataFrame([("  Ａ　b  ",)], "x string")
    assert one.select(scalars.name_key_unicode("x")).first()[0] == "a b"
    soft = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(scalars.softmax(F.col("v"))).first()[0]
    assert soft == [0.5, 0.5]


def test_suppression_in_score_order(spark):
    rows = [(1, 0.0, 10.0, 5.0, 1), (1, 1.0, 10.0, 4.0, 2), (1, 20.0, 5.0, 1.0, 3), (2, 0.0, 10.0, 1.0, 4)]
    df = spark.createDataFrame(rows, "u long, begin double, length double, score double, id long")
    assert sorted(r.id for r in suppression.suppress_intervals(df, "u", 0.5).collect()) == [1, 3, 4]


def test_streamed_batches_equal_the_batch(spark, tmp_path):
    from lacewing.streaming import live

    rows = [(1, NOW, 7, "purchase", 1.0), (2, NOW - HOUR, 7, "error", 2.0), (3, NOW + HOUR, 8, "signup", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for k in range(3):
        df.where(F.col("event_id") == k + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.event_stream(spark, f"{tmp_path}/in", df.schema)
    live.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    live.append_once(live.event_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    query = live.attempt_states(live.event_stream(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("fsm").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.user_id: r.state for r in spark.table("fsm").groupBy("user_id").agg(F.max_by("state", F.struct("since_us", "event_id")).alias("state")).collect()}
    assert last == {7: "stored", 8: "empty"}

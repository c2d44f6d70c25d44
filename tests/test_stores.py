import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lacewing.operators import assets, constraints, deck, digests, nested
from lacewing.operators.ledger import Refused

SHAPE = nested.Shape({"v": "bigint", "items": {"*": {"tags": ["string"], "note": "string?", "size": "double"}}})


def found(spark, **docs):
    df = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "k string, doc string")
    return {(r.k, r.path, r.fault) for r in nested.faults(df, ["k"], "doc", SHAPE).collect()}


def test_faults_at_any_depth(spark):
    good = {"v": 1, "items": {"a.b": {"tags": [], "note": None, "size": 1}, "c": {"tags": ["x"], "note": "n", "size": 1.5}}}
    got = found(
        spark, good=good, none={"v": 1, "items": {}}, torn='{"v": 1,', null=None, list_=[], more={**good, "extra": {"v": "x"}}, no_items={"v": 1}, v_null={"v": None, "items": {}}, v_text={"v": "1", "items": {}},
        deep={"v": 1, "items": {"c": {"tags": ["x", 1, None, ["y"]], "size": "big", "note": "n", "v": 2}, "d": {"tags": {"0": "x"}, "size": 2}, "e": 7}},
    )
    assert got == {
        ("torn", "$", "not JSON"), ("null", "$", "not JSON"), ("list_", "$", "type"), ("more", "$.extra", "unknown"), ("no_items", "$.items", "missing"), ("v_null", "$.v", "type"), ("v_text", "$.v", "type"),
        ("deep", "$.items.c.tags.1", "type"), ("deep", "$.items.c.tags.2", "type"), ("deep", "$.items.c.tags.3", "type"), ("deep", "$.items.c.size", "type"), ("deep", "$.items.c.v", "unknown"),
        ("deep", "$.items.d.tags", "type"), ("deep", "$.items.d.note", "missing"), ("deep", "$.items.e", "type"),
    }
    assert found(spark, dots={"v": 1, "items": {}, "items.c.size": 1}) == {("dots", "$.items.c.size", "unknown")}


def test_index_cards(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    art = {"ciid": 1, "image": f"images/7_1_{sha[:12]}.png", "sha256": sha}
    card = {"cid": 7, "name_ja": None, "name_en": "N", "name_ko": None, "source_url": "u7", "artworks": [art]}
    cases = {
        "good": {}, "cid": {"cid": 8}, "name": {"name_en": " "}, "name 2": {"name_en": None}, "address": {"source_url": "u8"}, "no artworks": {"artworks": []}, "artwork": {"artworks": [art, art]},
        "image": {"artworks": [{**art, "image": art["image"].replace("7", "8", 1)}]}, "sha256": {"artworks": [{**art, "sha256": sha[:40]}]}, "jpg": {"artworks": [{**art, "image": art["image"].replace("png", "jpg")}]},
    }
    df = spark.createDataFrame([(k, json.dumps({"schema": 1, "cards": {"7": {**card, **v}}})) for k, v in cases.items()] + [("schema", json.dumps({"schema": 2, "cards": {"7": card}}))], "k string, doc string")
    assert nested.faults(df, ["k"], "doc", nested.INDEX).count() == 0
    got = {r.k: r.problem for r in nested.index_cards(df, ["k"], "doc", F.concat(F.lit("u"), "card")).collect()}
    assert got == {k: None if k in ("good", "jpg") else k.split(" 2")[0] for k in [*cases, "schema"]}


PNG, JPG = bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("FFD8FF")


def entries(spark, *rows):
    return spark.createDataFrame([(c, i, bytearray(b)) for c, i, b in rows], "cid long, ciid long, content binary")


def test_a_store_of_contents(spark, tmp_path):
    db = assets.store(spark, f"file://{tmp_path}/db")
    seen, n = assets.upsert(db, entries(spark, (1, 1, PNG + b"a"), (1, 2, PNG + b"b"), (2, 1, PNG + b"a"), (2, 1, PNG + b"a")))
    assert n == {"cards": 2, "artworks": 3, "contents": 2}
    names = {(r.cid, r.ciid): r.image for r in db.read("artworks", seen).collect()}
    assert names[1, 2] == f"images/1_2_{hashlib.sha256(PNG + b'b').hexdigest()[:12]}.png"
    new, n = assets.upsert(db, entries(spark, (1, 1, JPG + b"c")))
    assert n == {"cards": 1, "artworks": 1, "contents": 1}
    state = lambda v: sorted((r.state, r.artworks) for r in assets.audit(db, v).collect())
    assert state(new) == [("garbage", 0), ("live", 1), ("live", 1)] and state(seen) == [("live", 1), ("live", 2)]
    for bad in ([(3, 1, b"GIF89a")], [(3, 1, PNG), (3, 1, JPG)], [(3, 1, PNG), (4, 1, b"")]):
        with pytest.raises(Refused):
            assets.upsert(db, entries(spark, *bad))
    assert db.head() == new
    swept, gone = assets.sweep(db)
    assert gone == 1 and state(swept) == [("live", 1), ("live", 1)] and state(new)[0] == ("garbage", 0)  # the version before still has it
    assert assets.sweep(db) == (swept, 0)
    assert len(db.forget()) == 3 and db.numbers() == [swept.number] and state(swept) == [("live", 1), ("live", 1)] and db.unnamed() == []


def test_a_crash_between_contents_and_index_loses_nothing(spark, tmp_path, monkeypatch):
    from lacewing.operators import ledger

    db = assets.store(spark, f"file://{tmp_path}/db")
    seen, _ = assets.upsert(db, entries(spark, (1, 1, PNG + b"a")))
    monkeypatch.setattr(ledger, "create_once", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    for step in (lambda: assets.upsert(db, entries(spark, (1, 1, PNG + b"b"))),):
        with pytest.raises(OSError):
            step()
    monkeypatch.undo()
    assert db.head() == seen and [r.state for r in assets.audit(db, seen).collect()] == ["live"]
    assert assets.upsert(db, entries(spark, (1, 1, PNG + b"b")))[1]["contents"] == 1
    monkeypatch.setattr(ledger, "create_once", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        assets.sweep(db)
    monkeypatch.undo()
    assert sorted(r.state for r in assets.audit(db, db.head()).collect()) == ["garbage", "live"] and assets.sweep(db)[1] == 1


def test_digests_of_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"n{i % 7}", None if i % 5 else i) for i in range(500)], "k int, name string, v int")
    whole = digests.fingerprint(digests.leaves(df, ["k"]))
    halves = digests.leaves(df.where("k < 200"), ["k"]).unionByName(digests.leaves(df.where("k >= 200"), ["k"]))
    assert whole == digests.fingerprint(digests.leaves(df.repartition(7).orderBy(F.desc("k")).select("v", "k", "name"), ["k"])) == digests.fingerprint(digests.merged(halves, 2))
    other = df.withColumn("v", F.when(F.col("k") == 77, 1).otherwise(F.col("v")))
    assert digests.fingerprint(digests.leaves(other, ["k"])) != whole
    assert digests.differing(digests.leaves(df, ["k"]), digests.leaves(other, ["k"])).count() == 1
    assert digests.fingerprint(digests.leaves(df.limit(0), ["k"])) == "0:0:0"


def test_changes(spark):
    old = spark.createDataFrame([(i, "a") for i in range(100)] + [(None, "n"), (5, "again")], "k int, v string")
    new = old.where("k is null or k not in (3, 4)").withColumn("v", F.when(F.col("k") == 9, None).when(F.col("k") == 10, "ab").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(200, "x"), (6, "a")], old.schema))
    got = {tuple(r) for r in digests.changes(old, new, ["k"]).collect()}
    assert got == {(3, "removed"), (4, "removed"), (9, "changed"), (10, "changed"), (200, "added"), (6, "changed")}
    assert digests.changes(old, old.repartition(5), ["k"]).count() == 0 == digests.changes(old.limit(0), old.limit(0), ["k"]).count()
    one = [digests.leaves(spark.createDataFrame([r], "a string, b string"), ["a"]).select("a").first()[0] for r in (("1", "2:x"), ("1:2", "x"), ("1", None), ("1", "-"))]
    assert len(set(one)) == 4


@pytest.mark.parametrize("most", [500_000, 0])
def test_constraints(spark, monkeypatch, most):
    monkeypatch.setattr(constraints, "BROADCAST_KEYS", most)
    before = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (None, "z", None)], "k int, n string, r int")
    batch = spark.createDataFrame([(2, "c", 10), (3, "a", 11), (3, "d", None), (None, "e", 10), (None, "e", 12), (5, None, 12)], before.schema)
    table = spark.createDataFrame([(10,), (None,)], "id int")
    rules = constraints.Constraints([["k"], ["n", "r"]], {"r": (["r"], table, ["id"])}, {"small": F.col("k") < 5, "any": F.col("r") > 0})
    assert {tuple(r) for r in constraints.violations(batch, before, rules).collect()} == {("unique k", "2", 1), ("unique k", "3", 2), ("reference r", "11", 1), ("reference r", "12", 2), ("check small", None, 1)}
    assert constraints.violations(batch.limit(0), before, rules).count() == 0


def test_audited_dumps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, v string")
    digest = digests.fingerprint(digests.leaves(df, ["k"]))
    assert constraints.audited(df, digest, {"rows": 3, "v": 2}, ["k"]).count() == 3
    with pytest.raises(ValueError, match="v: 2, not 3"):
        constraints.audited(df, digest, {"rows": 3, "v": 3}, ["k"])
    with pytest.raises(ValueError, match="another digest"):
        constraints.audited(df.withColumn("v", F.upper("v")), digest, {"rows": 3}, ["k"])


def test_deck_order_names_the_card_it_cannot_place(spark):
    cards = spark.createDataFrame([(1, 0, 0, 4, 100, 50, None, None), (2, 0, 0, 4, 100, 50, 9, None), (3, 1, 0, 0, 0, 0, 5, None), (4, 0, 0, None, 1, 1, 1, "level")], "cid int, group int, subtype int, level long, atk long, def long, passcode int, problem string")
    rows = spark.createDataFrame([(3, "N", 1), (1, "N", 1), (1, "R", 2), (2, "N", 3)], "cid int, rarity string, quantity int")
    got = deck.sorted_deck(rows, cards, ("R", "N")).orderBy("place").collect()
    assert [(r.cid, r.rarity, r.place) for r in got] == [(2, "N", 1), (1, "R", 2), (1, "N", 3), (3, "N", 4)]
    for bad, what in (((7, "N", 1), "card 7: not in"), ((4, "N", 1), "card 4: level"), ((1, "X", 1), "card 1: rarity")):
        with pytest.raises(Exception, match=what):
            deck.sorted_deck(rows.union(spark.createDataFrame([bad], rows.schema)), cards, ("R", "N")).collect()


def test_faults_read_a_document_once(spark):
    """As a union of levels every level parsed each document again, and each part of a document carried the names of all of it."""
    doc = "{" + ",".join(f'"card {i}":{{"cid":{i},"extra":null}}' for i in range(3000)) + "}"
    found = nested.faults(spark.createDataFrame([(1, doc)], "k int, doc string"), ["k"], "doc", nested.Shape({"*": {"cid": "bigint", "x": "string?"}}))
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("scan existingrdd") == 1 and "variant_explode" not in plan
    assert found.groupBy("fault").count().orderBy("fault").collect() == [("missing", 3000), ("unknown", 3000)]


def test_only_faults_become_rows(spark):
    """Every key of a document became a row at each level below it, sound or not; an object without any keys took all."""
    docs = {
        "first of two": '{"v": 1, "items": {}}, {', "repeated": '{"v": 1, "v": 1, "items": {}}', "long": '{"v": 9223372036854775808, "items": {}}', "whole": '{"v": 1.0, "items": {}}', "word": "nullx", "nan": '{"v": NaN, "items": {}}',
        "surrogate": '{"v": 1, "items": {"\\ud800": 1}}', "digits": '{"v": 1, "items": {"a": ' + "1" * 1001 + "}}", "levels": '{"v": 1, "x": ' + "[" * 1001 + "]" * 1001 + "}", "big": '{"v": 1, "items": {"a": {"tags": [], "note": null, "size": ' + "1" * 30 + "}}}",
    }
    torn = {(k, "$", "not JSON") for k in ("repeated", "word", "nan", "digits", "levels")}
    assert found(spark, **docs) == torn | {("long", "$.v", "type"), ("whole", "$.v", "type"), ("surrogate", "$.items.?", "type")}
    none = nested.faults(spark.createDataFrame([(1, '{"a": 1}'), (2, "{}")], "k int, doc string"), ["k"], "doc", nested.Shape({}))
    assert [tuple(r) for r in none.collect()] == [(1, "$.a", "unknown")] and none._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1

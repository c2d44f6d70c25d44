import random
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacewing.functions import scalars
from lacewing.operators import history, identity, layout, names
from lacewing.sources.tables import moment


def test_name_keys_of_any_script(spark):
    rng = random.Random(1)
    odd = ["", None, "  Ａ　b \x1c ", "Straße ΣΊΣΥΦΟΣ ﬁ", "İI ıi", "é é Å", "㍿ ½ ｶﾞ", "ꭰ Ꭰ ᏸ", "x\x85y z w​v", "ǅ Ⅷ ſ ẞ"]
    texts = odd + ["".join(chr(rng.choice([*range(1, 0x250), *range(0x370, 0x600), *range(0x1E00, 0x2100), *range(0xFB00, 0xFB50), *range(0xFF00, 0xFFA0)])) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.name_key_unicode("t").alias("k")).collect()
    want = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in texts]
    assert [(texts[r.i], r.k, want[r.i]) for r in rows if r.k != want[r.i]] == []
    one = spark.createDataFrame([("Spell  Reactor ・RE",), ("other",)], "t string")
    assert [r[0] for r in one.select(scalars.aliased(scalars.name_key_unicode("t"), names.ALIASES)).collect()] == ["spell reactor re", "other"]


def pages(spark, *rows):
    return spark.createDataFrame([(w, p, t, [(n, c) for n, c in cards], x) for w, p, t, cards, x in rows], "w string, page int, total int, cards array<struct<name:string,cid:int>>, problem string")


def test_exact_search(spark):
    df = pages(
        spark, ("a", 1, 5, [("A", 1), ("ab", 2)], None), ("a", 2, 5, [("b", 3), ("a", 1)], None), ("a", 3, 5, [("c", 4)], None), ("two", 1, 2, [("two", 1), ("TWO", 2)], None), ("no", 1, 1, [("n", 1)], None), ("none", 1, 0, [], None),
        ("lost", 1, 5, [("lost", 1), ("x", 2)], None), ("lost", 3, 5, [], None), ("torn", 1, 3, [("torn", 1)], None), ("torn", 2, 3, [], "row"), ("late", 2, 4, [("late", 1)], None), ("past", 1, 1, [("past", 1)], None), ("past", 2, 1, [], "no rows"),
    )
    got = {r.w: (r.cid, r.problem) for r in names.exact_ids(df, "w", F.lower("c.name"), 2).collect()}
    assert got == {"a": (1, None), "two": (None, "ambiguous"), "no": (None, "unknown"), "none": (None, "unknown"), "lost": (None, "missing page"), "torn": (None, "row"), "past": (1, None)} | {k: v for k, v in got.items() if k == "late"}
    assert got.get("late", (None, "missing page")) == (None, "missing page")


def test_cache_beside_the_search(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    wanted = make([(k,) for k in ("hit", "bad", "new", "lost", "other", "torn", "bare", "none", "new")], "key string")
    cached = make([("hit", 1, None), ("bad", 2, "address")], "key string, cid int, problem string")
    searched = make([("bad", 9, None), ("new", 3, None), ("lost", None, "unknown"), ("other", 4, None), ("torn", 5, None), ("bare", 6, None)], "key string, cid int, problem string")
    details = make([(3, "new", None), (4, "another", None), (5, "torn", "image")], "cid int, key string, problem string")
    got = {r.key: (r.cid, r.source, r.problem, r.keep) for r in names.resolved(wanted, cached, searched, details).collect()}
    assert got == {
        "hit": (1, "cache", None, False), "bad": (None, "cache", "address", False), "new": (3, "search", None, True), "lost": (None, "search", "unknown", False), "other": (None, "search", "other name", False),
        "torn": (None, "search", "image", False), "bare": (None, "search", "no detail page", False), "none": (None, None, "to search", False),
    }


def test_labels_and_guards(spark):
    rows, labels = spark.createDataFrame([(1, 0), (2, 1)], "v int, i int"), spark.createDataFrame([(0, "a"), (1, "b")], "i int, label string")
    assert {(r.v, r.label) for r in names.labelled(rows, labels, "i").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="no label 1"):
        names.labelled(rows, labels.where("i = 0"), "i").collect()
    names.checked("ja", ["N"], ("N", "R"), [1])
    for bad in (("xx", [], (), []), ("ja", ["Z"], ("N",), []), ("ja", [], (), [0]), ("ja", [], (), [True])):
        with pytest.raises(ValueError):
            names.checked(*bad)
    key, name = F.col("k"), F.col("n")
    df = spark.createDataFrame([("invoked babalon", "Invoked Babalon"), ("x", "X")], "k string, n string")
    assert [r[0] for r in df.select(names.keyword(key, name)).collect()] == ["Invoked Baybarron", "X"]
    boxes = spark.createDataFrame([(0.9, 1.0, 2.0), (0.1, 0.0, 2.0)], "score double, w double, h double")
    assert layout.detected(boxes, 0.5).count() == 1
    with pytest.raises(Exception, match="without size"):
        layout.detected(boxes, 0.0).collect()


def test_places_and_coverage(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    records = make([(1, [10, 11, 10]), (2, [11, 12]), (3, None)], "record int, ids array<int>")
    got = {tuple(r) for r in identity.records_of_ids(records, make([(10,), (11,), (12,), (13,)], "label int")).collect()}
    assert got == {(10, 1, 1, None), (11, None, 2, "ambiguous"), (12, 2, 1, None), (13, None, 0, "unplaced")}
    assert [r.cid for r in identity.outside(make([(1,), (1,), (2,), (None,)], "cid int"), make([(2,)], "cid int"), "cid").collect()] == [1]
    claims = make([(1, "ja", "printed"), (2, "ja", "printed"), (3, "ja", "no_printing"), (4, "ja", "no_printing"), (5, "ja", "printed")], "cid int, l string, coverage string")
    prints = make([(1, "ja"), (3, "ja"), (6, "ja")], "cid int, l string")
    listed = make([(i, "ja") for i in (1, 2, 3, 4, 7)], "cid int, l string")
    found = {(r.cid, r.finding) for r in identity.coverage_audit(claims, prints, listed, "cid", "l").collect()}
    assert found == {(2, "no prints"), (3, "has prints"), (5, "not listed"), (6, "not listed"), (7, "not covered")}


def test_unusable_and_resumed(spark):
    at = datetime(2024, 1, 2)
    seen = spark.createDataFrame([("a", at - timedelta(hours=13)), ("a", at - timedelta(hours=1)), ("b", at - timedelta(hours=12)), ("c", at + timedelta(seconds=1))], "k string, t timestamp_ntz")
    got = {r.k: (r.why, r.turn) for r in history.unusable(spark.createDataFrame([(k,) for k in "abcda"], "k string"), seen, ["k"], "t", moment(at)).collect()}
    assert got == {"a": (None, None), "b": ("expired", 0), "c": ("future", None), "d": ("never stored", 1)}
    now = spark.createDataFrame([(i, "x", None) for i in range(6)], "k int, a string, b int")
    old = spark.createDataFrame([(0, "x", None, None), (1, "y", None, None), (2, "x", 1, None), (3, "x", None, "torn"), (4, "x", None, None), (4, "x", None, None)], "k int, a string, b int, f string")
    assert {r.k: r.action for r in history.resumed(now, old, "k", ["a", "b"], F.col("f")).collect()} == {0: "reuse", 1: "fetch", 2: "fetch", 3: "broken", 4: "broken", 5: "fetch"}

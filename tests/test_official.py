"""Official pages and candidate order on small cases."""

from pyspark.sql import functions as F

from lacewing.operators import review
from lacewing.plans import official as plans
from lacewing.plans import shop
from lacewing.sources import official

BADGE = '<div class="lr_icon rid_{r}"><p>N</p><span>Normal</span></div>'
PRINT = '<div class="t_row"><input class="link_value" value="/x?ope=1&sess=1&pid=7&rp=99999"><i class="time">{d}</i><i class="card_number">{n}</i>{b}</div>'
HEAD = "<h1><span class='ruby'>あ</span> Red  Ring<span>EN</span></h1>"
CARD = '<div class="t_row c_normal open"><input class="cid" value="{c}"><input class="link_value" value="/x?ope=2&cid={l}"><span class="card_name">{n}</span></div>'


def test_detail_prints(spark):
    good = PRINT.format(d="2020-01-02", n="", b=BADGE.format(r=1) + BADGE.format(r=2))
    pages = {
        "good": HEAD + good, "twice": HEAD + PRINT.format(d="2020-01-02", n="A", b=BADGE.format(r=1) * 2), "date": HEAD + PRINT.format(d="soon", n="A", b=BADGE.format(r=1)), "bare": HEAD + PRINT.format(d="2020-01-02", n="A", b=""),
        "none": '<div class="no_data"></div>', "torn": "<p></p>", "other": HEAD.replace("Red", "Blue") + good,
    }
    rows = official.detail_prints(spark.createDataFrame([(k, "red ring", v) for k, v in pages.items()], "k string, name string, html string")).collect()
    assert {r.k: r.problem for r in rows} == {"good": None, "twice": "repeated badge", "date": "row", "bare": "no badge", "none": None, "torn": "heading", "other": "name"}
    prints = next(r for r in rows if r.k == "good").prints
    assert [(p.pid, p.card_number, [b.rid for b in p.rarities]) for p in prints] == [(7, "", [1, 2])]


def test_search_results(spark):
    total = '<div class="text">Search Results: 1 - 2 of 1,002</div>'
    pages = {"good": total + CARD.format(c=1, l=1, n="Sh'nn S'yo") + CARD.format(c=2, l=2, n="B"), "none": '<div class="no_data"></div>', "torn": total, "bare": CARD.format(c=1, l=1, n="A"), "link": total + CARD.format(c=1, l=2, n="A"), "name": total + CARD.format(c=1, l=1, n=" ")}
    rows = {r.k: r for r in official.search_results(spark.createDataFrame(list(pages.items()), "k string, html string")).collect()}
    assert {k: r.problem for k, r in rows.items()} == {"good": None, "none": None, "torn": "no rows", "bare": "total", "link": "link", "name": "name"}
    assert (rows["good"].total, [(c.cid, c.name) for c in rows["good"].cards], rows["none"].total) == (1002, [(1, "Sh'nn S'yo"), (2, "B")], 0)


def test_ranges_and_empty_tables(spark):
    text = '<div class="text">검색결과 101건 중 101~101건을 표시</div>'
    df = spark.createDataFrame([("ko", 2, text + CARD.format(c=1, l=1, n="A")), ("ja", 2, text), ("ko", 3, text), (None, 2, None)], "locale string, page int, html string")
    assert [r.problem for r in official.list_pages(df).orderBy("locale", "page").collect()] == ["count", "count", None, "page"]
    assert official.list_pages(df.limit(0)).count() == official.index_products(df.limit(0)).count() == 0


def test_decisions(spark):
    rows = [(1, 5, 24, 0.3, 0.2, None), (1, 6, 12, 0.9, 0.9, None), (2, 5, 24, 0.3, 0.2, "folded"), (3, 5, 24, 0.3, 0.2, None), (3, 6, 13, 0.3, 0.2, None), (4, 5, 12, 0.3, 0.2, None), (5, 5, 11, 0.3, 0.2, None), (6, 8, 12, 0.2, 0.2, None), (7, 9, 20, 0.3, 0.2, None), (7, 8, 20, 0.3, 0.2, None)]
    df = spark.createDataFrame(rows, "photo int, cid int, inliers int, ratio double, spread double, geometry_problem string")
    got = {r.photo: (r.cid, r.accepted) for r in review.decisions(df, ["photo"]).collect()}
    assert got == {1: (5, True), 2: (5, False), 3: (5, False), 4: (5, True), 5: (5, False), 6: (8, False), 7: (8, False)}
    assert review.decisions(df, ["photo"], 0).where("photo = 5").first().accepted
    c = spark.createDataFrame([([(1, "A"), (2, "b"), (3, "c"), (4, "B")],)], "c array<struct<cid:bigint,name:string>>")
    top = c.select(review.reference_first(F.struct(F.lit(9).cast("bigint").alias("cid"), F.lit("B").alias("name")), F.col("c")).alias("c")).first().c
    assert [x.cid for x in top] == [9, 1, 3]


def test_list_beyond_a_hundred_thousand_cards(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(100_000, 100_040)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = plans.list_cards(spark, str(tmp_path)).collect()
    assert len(rows) == 40 and {(r.n, r.problem) for r in rows} == {(5000, None), (5001, None)}


def test_pages_of_parts_are_dealt_to_all_cores(spark, tmp_path):
    """A small file is one task, however many cores there are, and its pages are long work."""
    spark.range(100).selectExpr("id as p_partkey", "'n' as p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert {q(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for q in (plans.detail_names, shop.search_pages)} == {True}


def test_prints_are_made_once(spark, tmp_path):
    """Prints of a page aren't made once more to count them first."""
    row = "1L l_orderkey, 2L l_partkey, 3 l_linenumber, timestamp '2024-01-02' l_shipdate"
    spark.sql(f"select {row}").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.detail_prints(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rid_([0-9]+)") == 1
    assert [tuple(r) for r in found.collect()] == [(2, None, 1, "N-1", "2024-01-02", "3")]

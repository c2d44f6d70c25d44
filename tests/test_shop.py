"""Listing and search pages, boxes and cards against plain rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import deck, layout, records
from lacewing.plans import official, shop
from lacewing.sources import listings

FOLDER = "/root/testdata/sf0.001"

BLOCK = (
    '<table id="list_card_{i}"><tr><td class="glist_01"><a href="goods_detail.php?goodsIdx={i}">Red &amp; <b>Blue</b></a></td><td class="glist_02">(AB12-JP0{i})</td><td class="glist_03">Rare</td><td class="glist_03"> </td>'
    '<s class="glist_price11">9,999</s><b class="glist_price12">{price}</b><i class="glist_price_won">원</i><img src="x/go_cart.gif" onclick="cartOneGo(\'{i}\')"><input name="comparechk_bLimit" value="1"><input value="{limit}" name="comparechk_limitCnt"></td></tr></table>'
)
FORM = '<form name="sortForm" action="goods_list.php"><input name="Index" value="288"><input name="searchstring" value="{n}"></form>'
URL = "http://shop.example/goods_list.php?Index=288"


def page(*blocks, number="AB12-JP01"):
    return FORM.format(n=number) + "".join(blocks)


def block(i=1, price="1,200", limit="3"):
    return BLOCK.format(i=i, price=price, limit=limit)


def problems(spark, pages, search=False):
    df = spark.createDataFrame([(k, URL, v, "AB12-JP01") for k, v in pages.items()], "k string, url string, html string, number string")
    rows = listings.searched(df, "number") if search else listings.parsed(df)
    return {r.k: r.problem for r in rows.select("k", "problem").collect()}


def test_a_fault_holds_back_its_page(spark):
    pages = {
        "good": page(block(1), block(2)), "twice": page(block(1), block(1)), "none": page(), "price": page(block(1), block(2, price="0")), "limit": page(block(1, limit="0")), "word": page(block(1, limit="x")),
        "nested": page(block(1).replace("<i class", block(2) + "<i class")), "unit": page(block(1).replace("원", "USD")), "link": page(block(1).replace("goodsIdx=1", "goodsIdx=9")), "rarity": page(block(1).replace("Rare", "")),
        "handler": page(block(1).replace("cartOneGo('1')", "cartOneGo('2')")), "both": page(block(1) .replace("</td></tr>", "품절</td></tr>")), "region": page(block(1).replace("-JP", "-KR")), "category": page(block(1)).replace("288", "276"), "null": None,
    }
    want = {"good": None, "twice": "repeated id", "none": "no products", "price": "price", "limit": "limit", "word": "limit", "nested": "nested", "unit": "currency", "link": "link", "rarity": "rarity", "handler": "handler", "both": "contradiction", "region": "region", "category": "category"}
    found = problems(spark, pages)
    assert {k: found[k] for k in want} == want and found["null"] is not None
    df = spark.createDataFrame([(URL, pages["good"]), (URL, pages["price"])], "url string, html string")
    rows = listings.products(listings.parsed(df), ["url"]).orderBy("product_id").collect()
    assert [(r.product_id, r.name, r.card_number, r.rarity, r.price_krw, r.stock) for r in rows] == [(str(i), "Red & Blue", f"AB12-JP0{i}", "Rare", 1200, "in_stock") for i in (1, 2)]


def test_search_pages(spark):
    empty = FORM.format(n="AB12-JP01") + listings.LIST_START + "\n " + listings.EMPTY_LIST.replace(" ", "\n ", 1) + listings.LIST_END
    pages = {"good": page(block(1)), "off": page(block(1), block(2)), "other": page(block(1), number="AB12-JP02"), "empty": empty, "torn": page(), "no form": block(1)}
    found = problems(spark, pages, search=True)
    assert found["empty"] is None and found["torn"] == "not an empty result" and found["off"] == "off target" and found["other"] == "search box" and found["good"] is None and found["no form"] == "form"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("pages", [shop.rendered, official.products_rendered])
def test_another_hand_is_learned_once(spark, pages):
    """Pages are written in the other hand, which is what rewriting each of them gives."""
    other = pages(spark, FOLDER, official.requoted)
    assert "regexp_replace" not in other._jdf.queryExecution().optimizedPlan().toString()
    rows = pages(spark, FOLDER).join(other.select("l_orderkey", F.col("html").alias("other")), "l_orderkey").select("html", "other").collect()
    for html, found in rows:
        for old, new in official.HAND:
            html = old.sub(new, html)
        assert found == html
    assert len(rows) > 1000


def test_a_block_is_judged_by_few_patterns(spark):
    """The number is matched once, and an image's name is what follows the last slash, if there is one."""
    pages = {"bare": page(block(1).replace("x/go_cart.gif", "go_cart.gif")), "deep": page(block(1).replace("x/go_cart.gif", "/a//go_cart.gif")), "folder": page(block(1).replace("x/go_cart.gif", "go_cart.gif/"))}
    found = listings.parsed(spark.createDataFrame([(k, URL, v) for k, v in pages.items()], "k string, url string, html string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(JP|KR)") == 1
    assert {r.k: (r.problem, [p.stock for p in r.products]) for r in found.collect()} == {"bare": (None, ["in_stock"]), "deep": (None, ["in_stock"]), "folder": (None, ["unknown"])}


def boxes(n):
    rng = np.random.default_rng(5)
    return [(1, i, float(rng.random()), *map(float, rng.uniform((0, 0, 20, 20, -3), (120, 120, 60, 60, 3)))) for i in range(n)]


def inside(polygon, xs, ys):
    edges = zip(polygon, np.roll(polygon, -1, axis=0))
    sides = np.array([(b[0] - a[0]) * (ys - a[1]) - (b[1] - a[1]) * (xs - a[0]) for a, b in edges])
    return (sides >= 0).all(axis=0) | (sides <= 0).all(axis=0)


def test_boxes_and_suppression(spark):
    df = spark.createDataFrame(boxes(40), "photo int, id long, score double, cx double, cy double, w double, h double, angle double")
    rows = df.select("photo", "id", "score", layout.corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "angle")]).alias("polygon"))
    held = sorted(rows.collect(), key=lambda r: (-r.score, r.id))
    shapes = {r.id: np.array(r.polygon) for r in held}
    for p in shapes.values():
        assert np.linalg.norm(p[1] - p[0]) <= np.linalg.norm(p[3] - p[0]) + 1e-9 and p[:2, 1].mean() <= p[2:, 1].mean()
    xs, ys = (g.ravel() for g in np.meshgrid(np.linspace(-40, 170, 700), np.linspace(-40, 170, 700)))
    grid = {i: inside(p, xs, ys) for i, p in shapes.items()}
    iou = lambda i, j: (grid[i] & grid[j]).sum() / (grid[i] | grid[j]).sum()
    a, b = rows.toDF("photo", "i", "s", "a"), rows.toDF("photo", "j", "t", "b")
    pairs = layout.overlaps(a.join(b, "photo").where("i < j").select("i", "j", "a", "b")).collect()
    assert len(pairs) == 780 and max(abs(r.iou - iou(r.i, r.j)) for r in pairs) < 0.02
    exact = {frozenset((r.i, r.j)): r.iou for r in pairs}
    kept = []
    for r in held:
        if all(exact[frozenset((r.id, k))] <= 0.2 for k in kept):
            kept.append(r.id)
    assert 0 < len(kept) < 40 and {r.id for r in layout.suppress_boxes(rows, ["photo"], 0.2).collect()} == set(kept)


def test_missing_metadata_ends_the_job(spark):
    row = spark.createDataFrame([(1, None)], "cid int, problem string")
    assert deck.complete(row).count() == 1
    with pytest.raises(Exception, match="metadata"):
        deck.complete(row.withColumn("problem", F.lit("metadata"))).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, html string")
    assert listings.products(listings.parsed(none), ["url"]).count() == 0
    box = spark.createDataFrame([], "photo int, id long, score double, polygon array<array<double>>")
    assert layout.suppress_boxes(box, ["photo"]).count() == 0
    rows = spark.createDataFrame([], "key int, name string, o int")
    assert records.best_evidence(rows, "key", "o", "o").count() == 0

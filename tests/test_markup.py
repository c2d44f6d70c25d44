import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacewing.operators import records
from lacewing.plans.official import shown_products
from lacewing.sources import markup, official

PAGE = """<!doctype html><DIV class='a  b' id=x><p>One<p>two &amp; <b>three</b></div>tail
<div class="b a" data='"q"'><div>in<div class=c>ner</div>side</div><br><img src='i' SRC="j"/></div></span>
<script>var x = "<div class='a'>";</script><!-- <div class="a"> -->"""


def df(spark, *pages):
    return spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn("n", markup.nodes("html"))


def test_nodes(spark):
    n = F.col("n")
    row = df(spark, PAGE).select(
        markup.texts(n, markup.classed(n, "a")).alias("a"), markup.texts(n, markup.classed(n, "a", "b")).alias("ab"), markup.texts(n, markup.classed(n, "c")).alias("c"),
        F.transform(markup.tagged(n, "img"), lambda x: markup.attribute(x, "src")).alias("src"), F.transform(markup.classed(n, "b"), lambda x: markup.attribute(x, "data")).alias("data"),
        F.transform(markup.tagged(n, "div"), lambda x: markup.own_text(markup.inside(n, x), x)).alias("own"), markup.text_of(n).alias("all"),
        markup.each(n, markup.tagged(n, "p"), lambda x, own: F.struct(x["parent"].alias("parent"), F.size(own).alias("size"))).alias("p"),
    ).first()
    assert row.a == row.ab == ["One two & three", "in ner side"] and row.c == ["ner"] and row.src == ["j"] and row.data == [None, '"q"']
    assert row.own == ["", "", "in side", "ner"] and row.all == "One two & three tail in ner side"
    assert [tuple(p) for p in row.p] == [(0, 5), (1, 3)]


def test_torn_pages(spark):
    rows = df(spark, None, "", "plain", "<a href=x", "</p></p>", "<p><b>x</p>y</b>", "<" * 50, "a\x00<p \x00=1>b</p>", "<p>" * 3000 + "deep").select("i", F.size("n").alias("k"), markup.text_of(F.col("n")).alias("t")).orderBy("i").collect()
    assert rows[0].k in (None, -1) and (rows[1].k, rows[1].t) == (0, "") and rows[2].t == "plain" and rows[5].t == "x y" and rows[8].t == "deep" and rows[8].k == 3001


def test_detail_cards(spark):
    card = "<h1>Fake</h1><div id='cardname'><h1> Red\n <span class=ruby>r</span> Ring <b>x</b></h1></div>"
    image = "<script>$('#card_image_1').attr('src',\n '/i?cid=1&enc=a');</script>"
    pages = {"good": card + image, "none": "<div class='x no_data'></div>", "torn": "<h1>Red</h1>" + image, "bare": card, "blank": "<div id=cardname><h1><span>x</span></h1></div>" + image, "open": card + image.replace("enc", "e"), "shown": card + "<p>" + image[8:-9]}
    rows = {r.k: r for r in official.detail_cards(spark.createDataFrame(list(pages.items()), "k string, html string")).collect()}
    assert {k: r.problem for k, r in rows.items()} == {"good": None, "none": None, "torn": "heading", "bare": "image", "blank": "name", "open": "unsigned image", "shown": "image"}
    assert (rows["good"].name, rows["good"].image, rows["none"].name) == ("Red Ring", "/i?cid=1&enc=a", None)


def test_artworks(spark):
    rows = [(1, 1, "ko", "k", False), (1, 1, "ja", "p", True), (1, 1, "en", "e", False), (1, 2, "en", "p", True), (1, 2, "ja", "p", True), (2, 1, "ja", "b", False), (2, 1, "ja", "a", None), (2, 1, "xx", "z", False), (3, 1, "xx", "z", False)]
    found = records.artworks(spark.createDataFrame(rows, "cid int, ciid int, l string, sha string, empty boolean"), ["cid", "ciid"], F.col("l"), "sha", F.col("empty"), ("ja", "en", "ko"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, "en", "e", "ja", False), (1, 2, None, None, "ja,en", True), (2, 1, "ja", "a", "", False)}


def test_picks_read_what_nodes_read(spark):
    """Plain tags are tokenized by one expression and read once for all alike; torn ones as ever. Both must give the nodes' answers."""
    bits = ["<p>", "</p>", "<b class='a  x'>", "<td  Class='y'\n id=3 />", "</b>", "a &amp; b", "<br>", "<title>", "</title>", "<script>", "</script>", "x > y", "<!-- c <p> -->", "<!--d-->", "<i class=a id=k1 href='/x?o=1&copy=2&c=4'>", "<", '>"', "</p x>", "<!doctype html>"]
    random = np.random.default_rng(3)
    pages = [None, "", PAGE, "a\x00<p \x00=1>b</p>", "<p class=a>" * 300, *("".join(random.choice(bits, random.integers(1, 12))) for _ in range(600))]
    n, q, inner = F.col("n"), F.col("q"), {"tag": markup.Pick("@class", markup.THIS), "p": markup.Pick("text", "p")}
    picks = {"text": markup.Pick("text", css="a"), "own": markup.Pick("own", css="a"), "ids": markup.Pick("@id", begins=(("id", "k"),)), "code": markup.Pick("value", "#script"), "held": markup.Pick("@class", "b", within="a"), "rows": markup.Pick(inner, "b", "x")}
    held = F.filter(markup.tagged(n, "b"), lambda x: F.exists(markup.classed(n, "a"), lambda y: (y["at"] < x["at"]) & (x["at"] <= y["last"])))
    want = F.struct(
        markup.texts(n, markup.classed(n, "a")).alias("text"), F.transform(markup.classed(n, "a"), lambda x: markup.own_text(markup.inside(n, x), x)).alias("own"),
        F.transform(F.filter(n, lambda x: F.coalesce(F.startswith(markup.attribute(x, "id"), F.lit("k")), F.lit(False))), lambda x: markup.attribute(x, "id")).alias("ids"),
        F.transform(F.filter(n, lambda x: x["tag"] == "#script"), lambda x: x["value"]).alias("code"), F.transform(held, lambda x: markup.attribute(x, "class")).alias("held"),
        markup.each(n, F.filter(markup.tagged(n, "b"), lambda x: markup.has_class(x, "x")), lambda x, own: F.struct(F.array(markup.attribute(x, "class")).alias("tag"), markup.texts(n, markup.tagged(own, "p")).alias("p"))).alias("rows"),
    )
    rows = df(spark, *pages).withColumn("q", markup.picked("html", **picks)).select("html", q, want.alias("want")).collect()
    assert len(rows) == len(pages) and rows[0].q is None and [r.html for r in rows if r.html is not None and r.q != r.want] == []


def nested(random, depth=0):
    """Markup whose elements are closed in turn."""
    out = []
    for kind in random.integers(0, 8, random.integers(0, 4)):
        if kind < 3 and depth < 5:
            start = random.choice(["<p>", "<b class='a  x'>", "<i class=a id=k1 href='/x?o=1&copy=2&c=4'>", "<s class=\"a 'q'\" id='k&amp;\"'>", "<B CLASS=x\nid=k9>", "<td  Class='y b'>"])
            out += [start, nested(random, depth + 1), f"</{start[1:].strip('>').split(' ')[0]}>"]
        else:
            out.append(random.choice(["<script>var 'x' \" > y &amp;</script>", "<title>a &amp; &bc</title>", "a &amp; b", "<br>", "x > y", "<!-- c <p> -->", "é한 &cid=3", " ", "<img src='' id=kk class=a />", "<input a=\"'\" class='&#97;'>", "t\n"]))
    return "".join(out)


def test_plain_pages_are_read_as_columns():
    """No plain page is read tag by tag, and columns hold what a stack of open elements gives."""
    random, torn = np.random.default_rng(4), ["<p>", "</b>", "<b", "<!-- a", "x\x00", "<a b='>"]
    inner = {"tag": markup.Pick("@class", markup.THIS), "p": markup.Pick("text", "p"), "own": markup.Pick("own", css="a", within="x"), "in": markup.Pick({"t": markup.Pick("text", markup.THIS)}, "b")}
    picks = {"text": markup.Pick("text", css="a"), "ids": markup.Pick("@id", begins=(("id", "k"),)), "code": markup.Pick("value", "#script"), "held": markup.Pick("@class", "b", within="a"), "rows": markup.Pick(inner, "b", "x"), "all": markup.Pick("own"), "link": markup.Pick("@href", "i", attrs=(("id", "k1"),))}
    plain = [None, "", *(nested(random) for _ in range(400))]
    reader = markup._Columns(picks)
    assert not markup.Tokens(pa.array(plain).fill_null(""), reader.form).torn.any()
    pages = [x for page in plain for x in (page, (page or "") + random.choice(torn))]
    want = markup._Picker(picks).array(pages).to_pylist()
    for first in (0, 7):
        assert reader.array(pa.array(pages).slice(first)).to_pylist() == want[first:]


def test_elements_are_made_once(spark):
    """Cards of a page aren't read once more to count them first."""
    pages = spark.createDataFrame([("a", "<p class=t_row>x</p>"), ("b", None), ("c", "")], "name string, html string")
    rows = shown_products(pages.selectExpr("1 as l_orderkey", "*"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and [r.cid for r in rows.collect()] == [None]


def test_few_pages_are_objects_at_once():
    """A batch of long pages would be gigabytes of Python objects."""
    html = pa.array(["<p>" * 100_000, None] * 20)
    parts = list(markup._slices(html))
    assert [x for part in parts for x in part] == html.to_pylist() and max(sum(len(x or "") for x in part) for part in parts) < 2 * markup.PAGES_AT_ONCE

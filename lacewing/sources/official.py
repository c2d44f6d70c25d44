"""Official list, product, detail and search pages: strict rows, with what is wrong with a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_value, without_space
from .markup import THIS, Pick, picked, single
from .tables import elements

#: How each locale writes a list's total and range, in that order of groups, and the pages' markup.
TOTALS = {
    "ja": (r"^検索結果\s*([\d,]+)件中\s*([\d,]+)[～~]([\d,]+)件を表示$", (1, 2, 3)),
    "en": (r"^Search Results:\s*([\d,]+)\s*-\s*([\d,]+)\s*of\s*([\d,]+)$", (3, 1, 2)),
    "ko": (r"^검색결과\s*([\d,]+)건\s*중\s*([\d,]+)[～~]([\d,]+)건을\s*표시$", (1, 2, 3)),
}
ROW, NO_DATA, DATE = "t_row", "no_data", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
IMAGE = r"\$\('#card_image_1'\)\.attr\('src',\s*'([^']+)'\)"
PAGE_SIZE = 100


_INPUT = lambda css: Pick("@value", "input", css)
CARD = {"cid": _INPUT("cid"), "link": _INPUT("link_value"), "name": Pick("text", css="card_name")}
BADGES = Pick({"class": Pick("@class", THIS), "p": Pick("text", "p"), "span": Pick("text", "span")}, "div", "lr_icon")
NONE = Pick("@class", "div", NO_DATA)
TEXT = Pick("text", css="text")


def rows_of(fields: dict[str, Pick]) -> Pick:
    return Pick(fields, css=ROW)


def value_of(found: Column) -> Column:
    """The value of the only input; null if there are none or several."""
    return single(found)


def no_data(page: Column) -> Column:
    return F.exists(page["none"], lambda x: x.isNotNull())


def counts(text: Column, locale: Column) -> Column:
    """(total, first, last) as the locale writes them; null in any other form."""
    out = F.lit(None).cast("struct<total:bigint,first:bigint,last:bigint>")
    for name, (pattern, groups) in TOTALS.items():
        number = lambda g, p=pattern: F.replace(F.regexp_extract(text, p, g), F.lit(","), F.lit("")).try_cast("long")
        out = F.when((locale == name) & text.rlike(pattern), F.struct(*[number(g).alias(n) for g, n in zip(groups, ("total", "first", "last"))])).otherwise(out)
    return out


def first_problem(rows: Column) -> Column:
    return F.get(F.filter(rows, lambda r: r["problem"].isNotNull()), F.lit(0))["problem"]


def repeated(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def card_row(own: Column) -> Column:
    cid, link, name = value_of(own["cid"]), F.regexp_extract(value_of(own["link"]), r"[?&]cid=([0-9]+)", 1), single(own["name"])
    problem = F.when(cid.isNull() | ~cid.rlike("^[0-9]+$"), "cid").when(F.coalesce(link, F.lit("")) != cid, "link").when(name.isNull(), "name")
    return F.struct(cid.try_cast("long").alias("cid"), name.alias("name"), problem.alias("problem"))


def list_pages(pages: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """`pages` (locale, page, html, …) with counts, cards and problem: the range must be that of the page, and the rows as many, each of
    a cid of its own. Totals that drift between pages are for `records.page_rules`."""
    page = F.col("page_picks")
    found = pages.withColumn("page_picks", picked("html", text=TEXT, rows=rows_of(CARD))).withColumn("counts", counts(single(page["text"]), F.col("locale"))).withColumn("cards", F.transform(page["rows"], card_row))
    total, first, last = (F.col(f"counts.{n}") for n in ("total", "first", "last"))
    at = (F.col("page") - 1) * size + 1
    problem = (
        F.when(F.col("counts").isNull(), "count").when((total <= 0) | (at > total) | (F.col("page") < 1), "page").when((first != at) | (last != F.least(F.col("page") * size, total)), "range")
        .when(F.size("cards") != last - first + 1, "rows").when(repeated(F.transform("cards", lambda c: c["cid"])), "repeated cid")
    )
    return found.withColumn("problem", F.coalesce(first_problem(F.col("cards")), problem)).drop("page_picks")


def index_products(pages: DataFrame) -> DataFrame:
    """(pid, name, released, problem) of product index pages, one row a pid: rows that repeat each other are one, rows that differ are a
    problem, as is a row that isn't whole."""
    page = F.col("page_picks")
    pid = lambda own: F.regexp_extract(value_of(own["link"]), r"^[^?]*\?ope=1&sess=1&pid=([0-9]+)&rp=99999$", 1).try_cast("long")
    rows = F.transform(page["rows"], lambda own: F.struct(pid(own).alias("pid"), single(own["name"]).alias("name"), single(own["time"]).alias("released")))
    picks = pages.select(picked("html", rows=rows_of({"link": _INPUT("link_value"), "name": Pick("text", css="main"), "time": Pick("text", css="time")})).alias("page_picks"))
    parts = elements(picks, rows, "row").select("row.*")
    fault = F.when(F.col("pid").isNull() | F.col("name").isNull() | ~F.coalesce(F.col("released").rlike(DATE), F.lit(False)), "row")
    merged = parts.withColumn("fault", fault).groupBy("pid").agg(F.min("name").alias("name"), F.min("released").alias("released"), F.max("name").alias("n"), F.max("released").alias("r"), F.max("fault").alias("fault"))
    return merged.select("pid", "name", "released", F.coalesce("fault", F.when((F.col("name") != F.col("n")) | (F.col("released") != F.col("r")), "differs")).alias("problem"))


def badges(found: Column) -> Column:
    """(rid, code, label) of each rarity badge."""
    rid = lambda n: F.regexp_extract(F.get(n["class"], F.lit(0)), r"(?:^|\s)rid_([0-9]+)(?:\s|$)", 1).try_cast("int")
    part = lambda texts: F.coalesce(F.get(texts, F.lit(0)), F.lit(""))
    return F.transform(found, lambda n: F.struct(rid(n).alias("rid"), part(n["p"]).alias("code"), part(n["span"]).alias("label")))


def badge_problem(found: Column) -> Column:
    bad = F.exists(found, lambda b: b["rid"].isNull() | (b["code"] == "") | (b["label"] == ""))
    return F.when(F.size(found) == 0, "no badge").when(bad, "badge").when(repeated(F.transform(found, lambda b: b["rid"])), "repeated badge")


def product_pages(pages: DataFrame) -> DataFrame:
    """`pages` (name, html, …) with cards (cid, name, rarities) and problem: the title is the indexed name but
    for white space, rows are as many as reported, and no cid stands twice."""
    page = F.col("page_picks")
    row = lambda own: with_value(badges(own["badges"]), lambda b: with_value(card_row(own), lambda c: F.struct(c["cid"].alias("cid"), c["name"].alias("name"), b.alias("rarities"), F.coalesce(c["problem"], badge_problem(b)).alias("problem"))))
    found = pages.withColumn("page_picks", picked("html", title=Pick("text", "title"), text=TEXT, rows=rows_of({**CARD, "badges": BADGES}))).withColumn("cards", F.transform(page["rows"], row))
    title = F.get(F.split(F.get(page["title"], F.lit(0)), r" \| "), F.lit(0))
    total = F.replace(F.regexp_extract(single(page["text"]), r"([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("long")
    problem = F.when(F.coalesce(without_space(title) != without_space(F.col("name")), F.lit(True)), "title").when(total.isNull() | (total != F.size("cards")), "total").when(repeated(F.transform("cards", lambda c: c["cid"])), "repeated cid")
    return found.withColumn("problem", F.coalesce(problem, first_problem(F.col("cards")))).drop("page_picks")


def detail_prints(pages: DataFrame) -> DataFrame:
    """`pages` (name, html, …) with prints (pid, card_number, released, rarities) and problem; a number may be blank, a page that says
    there is no data has no prints, and the heading must be the listed name."""
    page = F.col("page_picks")

    def row(own: Column) -> Column:
        pid, date = F.regexp_extract(value_of(own["link"]), r"[?&]pid=([0-9]+)&", 1).try_cast("long"), single(own["time"])
        number = F.get(own["number"], F.lit(0))
        fault = F.when(pid.isNull() | number.isNull() | ~F.coalesce(date.rlike(DATE), F.lit(False)), "row")
        return with_value(badges(own["badges"]), lambda b: F.struct(pid.alias("pid"), number.alias("card_number"), date.alias("released"), b.alias("rarities"), F.coalesce(fault, badge_problem(b)).alias("problem")))

    picks = rows_of({"link": _INPUT("link_value"), "time": Pick("text", css="time"), "number": Pick("text", css="card_number"), "badges": BADGES})
    found = pages.withColumn("page_picks", picked("html", h1=Pick("own", "h1"), none=NONE, rows=picks)).withColumn("heading", heading(page)).withColumn("prints", F.transform(page["rows"], row))
    problem = F.when(F.col("heading").isNull(), F.when(~no_data(page), "heading")).when(F.lower("heading") != F.lower("name"), "name")
    return found.withColumn("problem", F.coalesce(problem, first_problem(F.col("prints")))).drop("page_picks")


def heading(page: Column) -> Column:
    """The text that stands in the first heading itself, not in the spans of readings and translations; null if it is blank."""
    return F.nullif(F.get(page["h1"], F.lit(0)), F.lit(""))


def detail_cards(pages: DataFrame) -> DataFrame:
    """`pages` (html, …) with the card's name in the page's locale, the address of its image, and problem. A page that says that there is
    no data has neither; a page with a heading must have both, and the address must be a signed one."""
    page = F.col("page_picks")
    scripts = F.array_join(page["scripts"], "\n")
    named = Pick({"h1": Pick("own", "h1")}, attrs=(("id", "cardname"),))
    found = pages.withColumn("page_picks", picked("html", scripts=Pick("value", "#script"), named=named, none=NONE)).withColumn("within", F.get(page["named"], F.lit(0))["h1"])
    headed = F.size(F.coalesce(F.col("within"), F.array())) > 0
    name = F.get(F.col("within"), F.lit(0))
    found = found.withColumn("headed", headed).withColumn("name", F.when(headed, F.nullif(name, F.lit("")))).withColumn("image", F.when(headed, F.nullif(F.regexp_extract(scripts, IMAGE, 1), F.lit(""))))
    problem = F.when(~F.col("headed"), F.when(~F.coalesce(no_data(page), F.lit(False)), "heading")).when(F.col("name").isNull(), "name").when(F.col("image").isNull(), "image").when(~F.col("image").contains("enc="), "unsigned image")
    return found.withColumn("problem", problem).drop("page_picks", "within", "headed")


def search_results(pages: DataFrame) -> DataFrame:
    """`pages` (html, …) with total, cards (name, cid) and problem; no rows are right only where the page says so."""
    page = F.col("page_picks")
    found = pages.withColumn("page_picks", picked("html", text=TEXT, rows=rows_of(CARD), none=NONE)).withColumn("cards", F.transform(page["rows"], card_row)).withColumn("total", counts(single(page["text"]), F.lit("en"))["total"])
    none = F.size("cards") == 0
    problem = F.when(none & ~no_data(page), "no rows").when(~none & F.col("total").isNull(), "total")
    return found.withColumn("total", F.when(none, F.lit(0).cast("long")).otherwise(F.col("total"))).withColumn("problem", F.coalesce(first_problem(F.col("cards")), problem)).drop("page_picks")

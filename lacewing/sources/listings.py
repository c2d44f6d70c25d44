"""Shop listing and search pages: strict product rows, all of a page or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collapse, with_value
from .markup import THIS, Pick, only, picked, single

#: The markup of a listing, its categories and regions, and how numbers and prices are written.
CATEGORIES = {"288": "ja", "276": "ko"}
REGIONS = {"JP": "ja", "KR": "ko"}
NUMBER = r"^\(([0-9A-Z]{2,6}-(JP|KR)[A-Z]{0,2}[0-9]{2,3})\)$"
PRICE = r"^[0-9]{1,3}(,[0-9]{3})*$"
CURRENCY, SOLD_OUT = "원", "품절"
ACTIVE, INACTIVE = "go_cart.gif", "dis_go_cart.gif"
DETAIL = "goods_detail.php?goodsIdx="
LIST_START, LIST_END = "<!-- 상품 목록 시작 -->", "<!-- 상품 목록 끝 -->"
EMPTY_LIST = '<tr> <tr><td height="10"></td></tr> </form> </table></tr>'
FORM_ACTION = "goods_list.php"
CART = r"cartOneGo\('([^']*)'\)"
PRODUCT = "list_card_"


_INPUT = lambda name: Pick("@value", "input", attrs=(("name", name),))
BLOCK = Pick(
    {
        "id": Pick("@id", THIS), "text": Pick("text", THIS), "inner": Pick("@id", "table", begins=(("id", PRODUCT),)), "links": Pick("@href", "a"), "name_links": Pick("@href", "a", within="glist_01"),
        **{k: Pick("text", css=css) for k, css in (("name", "glist_01"), ("number", "glist_02"), ("rarity", "glist_03"), ("price", "glist_price12"), ("currency", "glist_price_won"))},
        "src": Pick("@src", "img"), "onclick": Pick("@onclick", "img"), "flags": _INPUT("comparechk_bLimit"), "limits": _INPUT("comparechk_limitCnt"),
    },
    "table", begins=(("id", PRODUCT),),
)
FORM = Pick({"action": Pick("@action", THIS), "index": _INPUT("Index"), "number": _INPUT("searchstring")}, "form", attrs=(("name", "sortForm"),))


def values(found: Column) -> Column:
    """The values of inputs; one without is empty."""
    return F.transform(found, lambda x: F.coalesce(x, F.lit("")))


def read(block: Column) -> Column:
    """What a product block says, unjudged: its number and price, if they are written as such."""
    file = lambda n: F.substring_index(F.coalesce(n["src"], F.lit("")), "/", -1)
    carts = F.filter(F.arrays_zip(block["src"].alias("src"), block["onclick"].alias("onclick")), lambda n: file(n).isin(ACTIVE, INACTIVE))
    price = single(block["price"])
    return with_value(carts, lambda carts: F.struct(
        F.regexp_extract(F.get(block["id"], F.lit(0)), f"^{PRODUCT}([0-9]+)$", 1).alias("id"),
        (F.size(block["inner"]) > 0).alias("nested"),
        F.filter(block["links"], lambda x: x.contains("goodsIdx=")).alias("links"),
        F.filter(block["name_links"], lambda x: x.isNotNull()).alias("name_links"),
        single(block["name"]).alias("name"), F.regexp_extract(single(block["number"]), NUMBER, 1).alias("number"),
        F.array_join(F.filter(block["rarity"], lambda x: x != ""), " ").alias("rarity"),
        F.when(price.rlike(PRICE), F.replace(price, F.lit(","), F.lit("")).cast("long")).alias("price"), single(block["currency"]).alias("currency"),
        F.size(carts).alias("carts"), F.get(F.transform(carts, file), F.lit(0)).alias("cart"),
        F.regexp_extract_all(F.get(F.transform(carts, lambda n: F.coalesce(n["onclick"], F.lit(""))), F.lit(0)), F.lit(CART), F.lit(1)).alias("handlers"),
        values(block["flags"]).alias("flags"), values(block["limits"]).alias("limits"),
        F.get(block["text"], F.lit(0)).contains(SOLD_OUT).alias("sold_out"),
    ))


def judged(p: Column, locale: Column) -> Column:
    """The product, its stock, and the first thing wrong with it."""
    regions = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    number, active, own = p["number"], F.coalesce(p["cart"] == ACTIVE, F.lit(False)), F.array(p["id"])
    price, limit = p["price"], F.get(p["limits"], F.lit(0))
    flagged = active & (p["handlers"] == own) & F.coalesce(F.get(p["flags"], F.lit(0)) == "1", F.lit(False)) & limit.isNotNull()
    stock = F.when(p["sold_out"], "out_of_stock").when(flagged, "in_stock").otherwise("unknown")
    strange = lambda values, good: F.exists(values, lambda x: x != good)
    problem = (
        F.when(p["id"] == "", "id").when(p["nested"], "nested").when(strange(p["links"], F.concat(F.lit(DETAIL), p["id"])), "link")
        .when(p["name_links"] != F.array(F.concat(F.lit(DETAIL), p["id"])), "name link").when(p["name"].isNull(), "name")
        .when(F.coalesce(number, F.lit("")) == "", "number").when(F.coalesce(regions[F.substring(F.substring_index(number, "-", -1), 1, 2)], F.lit("")) != F.coalesce(locale, F.lit("")), "region")
        .when(p["rarity"] == "", "rarity").when(p["currency"].isNull() | (p["currency"] != CURRENCY), "currency").when(F.coalesce(price, F.lit(0)) <= 0, "price")
        .when((p["carts"] > 1) | (F.size(p["flags"]) > 1) | (F.size(p["limits"]) > 1), "several carts").when(limit.isNotNull() & ~limit.rlike("^-?[0-9]+$"), "limit")
        .when(strange(p["handlers"], p["id"]), "handler").when(p["sold_out"] & active, "contradiction").when(flagged & ~p["sold_out"] & (limit.try_cast("long") <= 0), "limit")
    )
    return F.struct(p["id"].alias("product_id"), p["name"].alias("name"), number.alias("card_number"), locale.alias("locale"), p["rarity"].alias("rarity"), price.alias("price_krw"), stock.alias("stock"), F.concat(F.lit(DETAIL), p["id"]).alias("path"), problem.alias("problem"))


def parsed(pages: DataFrame) -> DataFrame:
    """`pages` (url, html, …) with products and `problem`, null where every product is sound and no id stands twice.

    A page's category is what its Index fields say and must be that of its address. Page by page, without any shuffle.
    """
    return _parsed(pages).drop("page_picks")


def _parsed(pages: DataFrame) -> DataFrame:
    categories = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    asked = F.regexp_extract_all("url", F.lit(r"[?&]Index=([^&#]*)"), F.lit(1))
    page = F.col("page_picks")
    rows = pages.withColumn("page_picks", picked("html", index=_INPUT("Index"), blocks=BLOCK, forms=FORM)).withColumn("locale", categories[only(asked)]).withColumn("shown", categories[only(values(page["index"]))])
    ids = lambda found: F.transform(found, lambda p: p["product_id"])
    off = F.when(F.col("locale").isNull() | F.col("shown").isNull() | (F.col("locale") != F.col("shown")), "category")
    wrong = lambda found: F.coalesce(F.get(F.filter(found, lambda p: p["problem"].isNotNull()), F.lit(0))["problem"], off.when(F.size(found) == 0, "no products").when(F.size(F.array_distinct(ids(found))) < F.size(found), "repeated id"))
    blocks = F.transform(page["blocks"], read)
    found = with_value(F.transform(blocks, lambda p: judged(p, F.col("locale"))), lambda found: F.struct(found.alias("products"), wrong(found).alias("problem")))
    return rows.withColumn("found", found).select("*", "found.*").drop("shown", "found")


def searched(pages: DataFrame, number: str) -> DataFrame:
    """The same for search pages: one form that names the category and repeats the number asked for, only products of that number, and
    a page without products only if its list is exactly that of an empty result."""
    forms = F.transform("page_picks.forms", lambda x: F.struct(F.get(x["action"], F.lit(0)).alias("action"), only(values(x["index"])).alias("index"), only(values(x["number"])).alias("number")))
    form = F.get("forms", F.lit(0))
    asked = only(F.regexp_extract_all("url", F.lit(r"[?&]Index=([^&#]*)"), F.lit(1)))
    inside = F.regexp_extract("html", "(?s)" + LIST_START + "(.*)" + LIST_END, 1)
    once = (F.regexp_count("html", F.lit(LIST_START)) == 1) & (F.regexp_count("html", F.lit(LIST_END)) == 1)
    rows = _parsed(pages).withColumn("forms", forms).drop("page_picks")
    empty = F.coalesce(rows.problem == "no products", F.lit(False))
    problem = (
        F.when((F.size("forms") != 1) | F.coalesce(form["action"] != FORM_ACTION, F.lit(True)), "form").when(F.coalesce(form["index"] != asked, F.lit(True)), "category")
        .when(F.coalesce(form["number"] != F.col(number), F.lit(True)), "search box")
        .when(empty, F.when(~once | (collapse(inside) != EMPTY_LIST), "not an empty result")).when(rows.problem.isNotNull(), rows.problem)
        .when(F.exists("products", lambda p: p["card_number"] != F.col(number)), "off target")
    )
    return rows.withColumn("problem", problem).drop("forms")


def products(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The products of sound pages, a row each, with the page's columns `keep`."""
    each = pages.select(*keep, F.explode_outer(F.when(F.col("problem").isNull(), F.col("products"))).alias("p"))
    return each.where("p is not null").select(*keep, "p.*").drop("problem")

"""Official pages rendered from the stand-in tables and read back, and candidates under review."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, review
from ..sources import official
from ..sources.tables import dealt, elements, table


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def card(cid: Column, name: Column, link: Column, more: Column | str = "", hand: Callable[..., Column] = joined) -> Column:
    return hand('<div class="t_row c_normal open"><input class="cid" value="', cid, '"><input class="link_value" value="/x?ope=2&cid=', link, '"><span class="card_name"> ', name, "</span>", more, "</div>")


def list_cards(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 20 parts in three locales by key; some links are wrong, some pages say a wrong range. Their total is that of full pages up to the last."""
    k = F.col("p_partkey")
    parts = dealt(table(spark, d, "part").select(F.floor(k / 20).alias("n"), k, "p_name"), "n")
    rows = parts.select("n", k, card(k, F.col("p_name"), F.when(k % 333 == 332, 0).otherwise(k)).alias("row"))
    pages = rows.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("row")), "").alias("rows"))
    n, first = F.col("n"), F.col("n") * 20 + 1
    last = F.col("n") * 20 + F.when(F.col("n") % 7 == 6, 19).otherwise(20)
    cards = F.format_number(table(spark, d, "part").agg((F.floor(F.max(k) / 20) + 1) * 20).scalar(), 0)
    text = F.when(n % 3 == 0, joined("検索結果 ", cards, "件中 ", first, "～", last, "件を表示")).when(n % 3 == 1, joined("Search Results: ", first, " - ", last, " of ", cards)).otherwise(joined("검색결과 ", cards, "건 중 ", first, "~", last, "건을 표시"))
    html = joined('<div class="sort_set"><div class="text">', text, "</div></div>", F.col("rows"))
    locale = F.when(n % 3 == 0, "ja").when(n % 3 == 1, "en").otherwise("ko")
    found = official.list_pages(pages.select("n", locale.alias("locale"), (n + 1).alias("page"), html.alias("html")), 20)
    return elements(found, F.col("cards"), "c", "n", "locale", "problem").select("n", "locale", "problem", "c.cid", "c.name")


def badge(rid: Column, code: Column, hand: Callable[..., Column] = joined) -> Column:
    return hand('<div class="lr_icon rid_', rid, '"><p>', code, "</p><span>", code, " Rare</span></div>")


#: The rules of another hand: other quotes, order of attributes and case, and elements of one name within each other.
HAND = [(re.compile(a), b) for a, b in (
    (r" (class|id|name|value|href|src|action)=\"([^\"']*)\"", r" \1='\2'"),
    (r"<(input|img) (\w+)='([^']*)' (\w+)=('[^']*'|\"[^\"]*\")>", r"<\1 data-x  \4=\5\n \2='\3' />"),
    ("<td ", "<TD  "), ("</td>", "</Td >"), (r"(<TD  class='glist_0[23]'>)([^<]*)</Td >", r"\1<table><tr><td>\2</td></tr></table></TD>"),
    (r"(<div class='(?:t_row|lr_icon)[^>]*>)", r"\1<div ><div></div></div>"),
    (r"<span class='card_name'>([^<]*)</span>", r"<span id=x class='card_name other'><span>\1</span><!-- </span> --></span>"),
)]


def requoted(*parts: Column | str) -> Column:
    """The same parts, joined, in another hand: rewritten once as a page with gaps, not page by page. What fills the gaps is plain text or
    was rewritten itself."""
    page, gaps = "", []
    for p in parts:
        page += p if isinstance(p, str) else f"\x01{len(gaps)}\x02"
        gaps += [] if isinstance(p, str) else [p]
    for old, new in HAND:
        page = old.sub(new, page)
    return joined(*[gaps[int(p)] if i % 2 else p for i, p in enumerate(re.split("\x01([0-9]+)\x02", page))])


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    return shown_products(products_rendered(spark, d))


def requoted_products(spark: SparkSession, d: str) -> DataFrame:
    return shown_products(products_rendered(spark, d, requoted))


def shown_products(pages: DataFrame) -> DataFrame:
    found = official.product_pages(pages)
    return elements(found, F.col("cards"), "c", "l_orderkey", "problem").select("l_orderkey", "problem", "c.cid", F.array_join(F.transform("c.rarities", lambda b: joined(b["rid"], ":", b["label"])), ",").alias("rarities"))


def products_rendered(spark: SparkSession, d: str, hand: Callable[..., Column] = joined) -> DataFrame:
    """A product page for each order, a row for each part in it, badges by line number; the title has other white space."""
    lines = dealt(table(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("rids"))
    icons = F.array_join(F.transform("rids", lambda r: badge(r, F.when(r == 7, "").otherwise(joined("R", r)), hand)), "")
    row = card(F.col("l_partkey"), joined("Card ", F.col("l_partkey")), F.col("l_partkey"), icons, hand)
    pages = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    k = F.col("l_orderkey")
    html = hand("<title>Product  ", F.when(k % 41 == 0, 0).otherwise(k), ' | Shop</title><div class="text">', F.col("n") + F.when(k % 37 == 0, 1).otherwise(0), " cards</div>", F.col("rows"))
    return pages.select("l_orderkey", joined("Product ", k).alias("name"), html.alias("html"))


def product_index(spark: SparkSession, d: str) -> DataFrame:
    """An index page for each customer's orders with a row for each line of them, so that an order stands often; some differ."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = joined("Product ", F.col("o_orderkey"), F.when((F.col("l_linenumber") == 7) & (F.col("o_orderkey") % 5 == 0), " b").otherwise(""))
    row = joined('<div class="t_row"><input class="link_value" value="/x?ope=1&sess=1&pid=', F.col("o_orderkey"), '&rp=99999"><b class="main">', name, '</b><i class="time">', F.date_format("o_orderdate", "yyyy-MM-dd"), "</i></div>")
    pages = rows.groupBy("o_custkey").agg(F.array_join(F.collect_list(row), "").alias("html"))
    return official.index_products(pages)


def detail_prints(spark: SparkSession, d: str) -> DataFrame:
    """A detail page for each part with a print for each order it is in; some pages have another heading, none, or a date in words."""
    k = F.col("l_partkey")
    lines = dealt(table(spark, d, "lineitem"), "l_partkey").groupBy("l_partkey", "l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("rids"), F.min("l_shipdate").alias("day"))
    icons = F.array_join(F.transform("rids", lambda r: badge(r, joined("R", r))), "")
    day = F.when((k % 23 == 0) & (F.col("l_orderkey") % 2 == 0), "soon").otherwise(F.date_format("day", "yyyy-MM-dd"))
    row = joined('<div class="t_row"><input class="link_value" value="/x?ope=1&sess=1&pid=', F.col("l_orderkey"), '&rp=99999"><i class="time">', day, '</i><i class="card_number">', F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(joined("N-", F.col("l_orderkey"))), "</i>", icons, "</div>")
    pages = lines.groupBy("l_partkey").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    head = F.when(k % 19 == 0, "").otherwise(joined("<h1><span class='ruby'>x</span> Card  ", F.when(k % 17 == 0, 0).otherwise(k), "<span>EN</span></h1>"))
    found = official.detail_prints(pages.select("l_partkey", joined("card ", k).alias("name"), joined(head, F.col("rows")).alias("html")))
    return elements(found, F.col("prints"), "p", "l_partkey", "problem").select("l_partkey", "problem", "p.pid", "p.card_number", "p.released", F.array_join(F.transform("p.rarities", lambda b: b["rid"].cast("string")), ",").alias("rarities"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """A search page for each size of part; some have no total, a size of a multiple of ten finds nothing, and one of seven says not even that."""
    k, size = F.col("p_partkey"), F.col("p_size")
    row = card(k, F.col("p_name"), F.when(k % 997 == 0, 0).otherwise(k))
    pages = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.array_join(F.collect_list(row), "").alias("rows"))
    total = F.when(size % 11 == 0, "").otherwise(joined('<div class="sort_set"><div class="text">Search Results: 1 - ', F.col("n"), " of ", F.format_number(F.col("n") + 5000, 0), "</div></div>"))
    html = F.when(size % 10 == 0, F.when(size % 7 == 0, "<p></p>").otherwise('<div class="no_data"></div>')).otherwise(joined(total, F.col("rows")))
    found = official.search_results(pages.select("p_size", html.alias("html")))
    return found.select("p_size", "total", "problem", F.explode_outer("cards").alias("c")).select("p_size", "total", "problem", "c.cid", "c.name")


def detail_names(spark: SparkSession, d: str) -> DataFrame:
    """A part's detail page in three locales: one in five isn't in the second, some have no image, no name, or an address without signature."""
    k, locale = F.col("p_partkey"), F.explode(F.array(*map(F.lit, ("ja", "en", "ko")))).alias("locale")
    rows = dealt(table(spark, d, "part").select(k, "p_name"), "p_partkey").select(k, "p_name", locale)
    name = F.when(k % 29 == 0, "").otherwise(joined(F.col("p_name"), " &amp; ", F.col("locale")))
    address = joined("/image?cid=", k, F.when(k % 31 == 0, "").otherwise("&enc=a"), "&l=", F.col("locale"))
    script = F.when(k % 37 == 0, "").otherwise(joined("<script>$('#card_image_1').attr('src', '", address, "');</script>"))
    html = F.when((k % 5 == 0) & (F.col("locale") == "en"), '<div class="no_data">none</div>').otherwise(joined('<div id="other"><h1>Other</h1></div><div id="cardname"><h1><span class="ruby">r</span>\n ', name, " <span>EN</span></h1></div>", script))
    return official.detail_cards(rows.select(k, "locale", html.alias("html"))).drop("html")


def artwork_union(spark: SparkSession, d: str) -> DataFrame:
    """Lines as artworks of parts in three locales, a fifth of them placeholders."""
    locale = F.element_at(F.array(*map(F.lit, ("ko", "ja", "en", "xx"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"), (F.col("l_suppkey") % 4 + 1).alias("ciid"), locale.alias("locale"), F.md5(joined(F.col("l_orderkey"), ":", F.col("l_linenumber")).cast("binary")).alias("digest"), (F.col("l_quantity") > 30).alias("empty"))
    return records.artworks(rows, ["cid", "ciid"], F.col("locale"), "digest", F.col("empty"), ("ja", "en", "ko"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Events as evidence: a photo a user and day, a card an event."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), e.alias("cid"), F.floor("value").alias("inliers"), (e % 10 / 10).alias("ratio"), (e % 7 / 10).alias("spread"), F.when(e % 5 == 0, "folded").alias("geometry_problem"))
    return review.decisions(rows, ["user_id", "day"])


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Each order's first parts as candidates: with evidence, the last one in front, then under a reference of the first's brand."""
    some = F.slice(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber"), F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("inliers"), F.concat(F.lit("S"), F.col("l_partkey") % 3).alias("name")))), 1, 5)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(some.alias("c"))
    even = F.map_from_entries(F.array_distinct(F.transform(F.filter("c", lambda x: x["cid"] % 2 == 0), lambda x: F.struct(x["cid"].alias("cid"), (x["cid"] % 50).alias("inliers")))))
    found = rows.select("l_orderkey", review.with_evidence(F.col("c"), even).alias("c"))
    order = found.select("l_orderkey", review.winner_first(F.col("c"), lambda x: x["inliers"] >= 25).alias("c"))
    last = order.select("l_orderkey", "c", review.reference_first(F.struct(F.lit(-1).cast("bigint").alias("cid"), F.lit("s1").alias("name"), F.lit(0).cast("bigint").alias("inliers")), F.col("c")).alias("top"))
    text = lambda c: F.array_join(F.transform(c, lambda x: joined(x["cid"], ":", x["inliers"])), ",")
    return last.select("l_orderkey", text(F.col("c")).alias("candidates"), text(F.col("top")).alias("top"))


QUERIES = {"official_list": list_cards, "product_cards": product_pages, "requoted_products": requoted_products, "detail_prints": detail_prints, "search_results": search_results, "detail_names": detail_names, "artwork_union": artwork_union, "product_index": product_index, "match_decisions": decisions, "candidate_review": shown}
PRODUCTS = """with l as (select distinct l_orderkey, l_partkey, l_linenumber as r from lineitem), c as (select l_orderkey, l_partkey as cid, string_agg(r || ':' || case when r = 7 then ' Rare' else 'R' || r || ' Rare' end, ',' order by r) as rarities, max(r) as most from l group by all),
        p as (select l_orderkey, case when l_orderkey % 41 = 0 and l_orderkey <> 0 then 'title' when l_orderkey % 37 = 0 then 'total' when max(most) = 7 then 'badge' end as problem from c group by 1)
        select l_orderkey, problem, cid, replace(rarities, ': Rare', ':Rare') as rarities from c join p using (l_orderkey)"""
SQL = {
    "requoted_products": PRODUCTS,
    "detail_prints": """with p as (select l_partkey, l_orderkey, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as rarities, min(l_shipdate) as day from lineitem group by all),
        g as (select l_partkey, case when l_partkey % 19 = 0 then 'heading' when l_partkey % 17 = 0 and l_partkey <> 0 then 'name' when l_partkey % 23 = 0 and count(*) filter (l_orderkey % 2 = 0) > 0 then 'row' end as problem from p group by 1)
        select l_partkey, problem, l_orderkey as pid, case when l_orderkey % 5 = 0 then '' else 'N-' || l_orderkey end as card_number, case when l_partkey % 23 = 0 and l_orderkey % 2 = 0 then 'soon' else strftime(day, '%Y-%m-%d') end as released, rarities from p join g using (l_partkey)""",
    "search_results": """with g as (select p_size, count(*) as n, count(*) filter (p_partkey % 997 = 0 and p_partkey <> 0) as bad from part group by 1),
        r as (select p_size, case when p_size % 10 = 0 then 0 when p_size % 11 <> 0 then n + 5000 end::bigint as total, case when p_size % 10 = 0 then case when p_size % 7 = 0 then 'no rows' end when bad > 0 then 'link' when p_size % 11 = 0 then 'total' end as problem from g)
        select p_size, total, problem, p_partkey as cid, p_name as name from r left join part using (p_size) where p_size % 10 <> 0 union all select p_size, total, problem, null, null from r where p_size % 10 = 0""",
    "detail_names": """with r as (select p_partkey, p_name, unnest(['ja', 'en', 'ko']) as locale from part), q as (select *, p_partkey % 5 = 0 and locale = 'en' as gone from r)
        select p_partkey, locale, case when not gone and p_partkey % 29 <> 0 then p_name || ' & ' || locale end as name, case when not gone and p_partkey % 37 <> 0 then '/image?cid=' || p_partkey || case when p_partkey % 31 = 0 then '' else '&enc=a' end || '&l=' || locale end as image,
          case when gone then null when p_partkey % 29 = 0 then 'name' when p_partkey % 37 = 0 then 'image' when p_partkey % 31 = 0 then 'unsigned image' end as problem from q""",
    "artwork_union": """with r as (select l_partkey as cid, l_suppkey % 4 + 1 as ciid, l_linenumber % 4 as at, md5(l_orderkey || ':' || l_linenumber) as digest, l_quantity > 30 as empty from lineitem where l_linenumber % 4 <> 3),
        n as (select *, case r.at when 1 then 0 when 2 then 1 else 2 end as rank from r), g as (select cid, ciid, min((rank, digest)) filter (not empty) as f from n group by all),
        t as (select n.cid, n.ciid, array_to_string(list_transform(list_sort(list(distinct n.rank) filter (n.empty and (f is null or n.rank < f[1]))), lambda r: ['ja', 'en', 'ko'][r + 1]), ',') as placeholders from n join g using (cid, ciid) group by all)
        select cid, ciid, ['ja', 'en', 'ko'][f[1] + 1] as locale, f[2] as digest, coalesce(placeholders, '') as placeholders, f is null as unavailable from g join t using (cid, ciid)""",
    "official_list": """with p as (select p_partkey // 20 as n, p_partkey as cid, p_name as name from part), g as (select n, case when count(*) filter (cid % 333 = 332) > 0 then 'link' when n % 7 = 6 then 'range' when count(*) <> 20 then 'rows' end as problem from p group by n)
        select n, case n % 3 when 0 then 'ja' when 1 then 'en' else 'ko' end as locale, problem, cid, name from p join g using (n)""",
    "product_cards": PRODUCTS,
    "product_index": """with r as (select o_orderkey, o_orderdate, 'Product ' || o_orderkey || case when l_linenumber = 7 and o_orderkey % 5 = 0 then ' b' else '' end as name from lineitem join orders on l_orderkey = o_orderkey)
        select o_orderkey as pid, min(name) as name, strftime(min(o_orderdate), '%Y-%m-%d') as released, case when min(name) <> max(name) then 'differs' end as problem from r group by 1""",
    "match_decisions": """with e as (select *, ts::date as day, floor(value)::bigint as inliers, row_number() over (partition by user_id, ts::date order by floor(value) desc, event_id) as k from events),
        t as (select user_id, day, max(event_id) filter (k = 1) as cid, max(inliers) filter (k = 1) as a, coalesce(max(inliers) filter (k = 2), 0) as b from e group by all)
        select user_id, day, cid, round_even(a / greatest(b, 1) * 100, 0) / 100 as margin, cid % 5 <> 0 and a >= 12 and cid % 10 / 10 >= 0.25 and cid % 7 / 10 >= 0.15 and a / greatest(b, 1) >= 2 as accepted from t""",
    "candidate_review": """with r as (select l_orderkey, l_partkey as cid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k, case when l_partkey % 2 = 0 then l_partkey % 50 else 0 end as i from lineitem),
        o as (select *, row_number() over (partition by l_orderkey order by case when i >= 25 then 0 else 1 end, k) as p from r where k <= 5), n as (select *, row_number() over (partition by l_orderkey order by p) as q from o where cid % 3 <> 1),
        a as (select l_orderkey, string_agg(cid || ':' || i, ',' order by p) as candidates from o group by 1), b as (select l_orderkey, string_agg(cid || ':' || i, ',' order by q) as t from n where q <= 2 group by 1)
        select l_orderkey, candidates, '-1:0' || coalesce(',' || t, '') as top from a left join b using (l_orderkey)""",
}

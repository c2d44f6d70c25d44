"""Deck, export, text, page and matching queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import deck, matching, names, search
from ..operators.suppression import suppress_intervals
from ..sources import pages as html
from ..sources.tables import table


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"), F.col("l_returnflag").alias("rarity"), "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


FIRST = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def deck_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return deck.aggregate(entries(spark, d), ["cid", "rarity"], "l_quantity", FIRST, ["l_orderkey", "l_suppkey"])


def deck_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return deck.conflicts(entries(spark, d), ["cid"], ["rarity"])


def part_order(spark: SparkSession, d: str) -> DataFrame:
    stat = F.when(F.col("p_size") % 10 == 0, -1).otherwise(F.round("p_retailprice").cast("long"))
    rows = deck.deck_order(table(spark, d, "part"), deck.ordinal(F.col("p_type"), deck.GROUPS), F.col("p_size"), stat, F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 100), F.col("p_partkey"))
    return rows.select("p_partkey", "k_group", "k_level", "k_stat", "k_passcode", "place")


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    own = deck.aggregate(entries(spark, d), ["cid", "rarity"], "l_quantity", FIRST, ["l_extendedprice"])
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("name"))
    named = own.join(parts, "cid", "left")
    rows = deck.complete(named.withColumn("problem", F.when(F.col("name").isNull(), F.concat(F.lit("no name of card "), F.col("cid").cast("string"))))).withColumn("unit_price", F.when(F.col("rarity") != "A", F.round("l_extendedprice").cast("long")))
    return deck.priced_rows(rows, {"total", "cid", "name", "rarity", "quantity", "unit_price"})


def neutralize(spark: SparkSession, d: str) -> DataFrame:
    starts = F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "\r", "", "a=")])
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(starts).alias("kind", "start"), "text")
    return rows.select("item_id", F.col("kind").cast("long").alias("kind"), scalars.neutralized(F.concat("start", "text")).alias("cell"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


ALIASES = {"small red item": "red item"}


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.name_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t Item ")), ALIASES).alias("name_key"), scalars.without_space(F.col("p_name")).alias("compact"))


def name_keys_unicode(spark: SparkSession, d: str) -> DataFrame:
    """The keys of whole texts, and of official names in other forms through the aliases."""
    forms = [*names.ALIASES, *[x.upper() for x in names.ALIASES], "ｉｎｖｏｋｅｄ　Ｂａｙｂａｒｒｏｎ"]
    text = F.when(F.col("doc_id") % 50 == 0, F.element_at(F.array(*map(F.lit, forms)), (F.expr("doc_id div 50") % len(forms) + 1).cast("int"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", scalars.aliased(scalars.name_key_unicode(text), names.ALIASES).alias("name_key"))


def money(spark: SparkSession, d: str) -> DataFrame:
    text = scalars.money_text(F.round(F.col("p_retailprice") * 1000).cast("long"))
    return table(spark, d, "part").select("p_partkey", text.alias("shown"), scalars.money_value(text).alias("value"))


def local_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.kst_text(F.col("ts")).alias("kst"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    return html.fields(table(spark, d, "pages"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages")).withColumn("place", F.col("place").cast("long"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in html.url_parts(F.col("url")).items()])


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries, every vec_id that 50 divides, and all vectors."""
    own = table(spark, d, "embeddings")
    return own.where("vec_id % 50 = 0"), own


def knn(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(*vectors(spark, d), 8).select("query", "vec_id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"))


def ratio_vote(spark: SparkSession, d: str) -> DataFrame:
    queries, own = vectors(spark, d)
    votes = matching.ratio_votes(search.nearest_labels(queries, own), 0.95)
    return votes.select("query", "label", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), "distinctive")


def shared_vote(spark: SparkSession, d: str) -> DataFrame:
    queries, own = vectors(spark, d)
    return matching.shared_votes(search.nearest(queries, own, 8), own, 0.95)


def margin_decision(spark: SparkSession, d: str) -> DataFrame:
    return matching.margins(search.nearest(*vectors(spark, d), 8), 2.0).withColumn("margin", F.round("margin", 6))


def mutual_match(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries whose nearest of all vectors has them as its nearest of all vectors."""
    queries, own = vectors(spark, d)
    forward = search.nearest(queries, own, 1)
    found = own.join(forward.select("vec_id").distinct(), "vec_id", "left_semi")
    return matching.mutual(forward, search.nearest(found, own, 1)).withColumn("distance", F.round("distance", 6))


def cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the true neighbours of all stated queries the search in cells finds, and whether that is enough."""
    queries, own = vectors(spark, d)
    found, _, _ = search.nearest_in_cells(queries, own, 8)
    truth = search.nearest(queries, own, 8).select("query", "vec_id")
    both = truth.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.95 * F.count("*")).alias("enough"))


def softmax_top(spark: SparkSession, d: str) -> DataFrame:
    """The three likeliest components of each vector, scaled by 10, and whether the row needs review."""
    p = scalars.softmax(F.transform("embedding", lambda x: x.cast("double") * 10))
    likely = F.slice(F.sort_array(F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("i")))), 1, 3)
    top = table(spark, d, "embeddings").select("vec_id", likely.alias("t"))
    first, second = -F.col("t")[0]["p"], -F.col("t")[1]["p"]
    return top.select("vec_id", F.col("t")[0]["i"].cast("long").alias("top1"), F.col("t")[1]["i"].cast("long").alias("top2"), F.col("t")[2]["i"].cast("long").alias("top3"), F.round(first, 6).alias("p1"), ((first < 0.5) | (first - second < 0.1)).alias("review"))


def suppression(spark: SparkSession, d: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    rows = table(spark, d, "events").select("user_id", seconds.alias("begin"), (F.col("value") * 60).alias("length"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return suppress_intervals(rows, "user_id", 0.5)


def fingerprint_change(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("digest", F.md5(F.concat_ws("|", "role", "text").cast("binary")))
    return rows.select("conv_id", "turn", "digest", F.coalesce(F.lag("digest").over(order) != F.col("digest"), F.lit(True)).alias("changed"))


NEAR = """
near as (
  select *, row_number() over (partition by query order by distance, vec_id) as place from (
    select q.vec_id as query, q.label as query_label, v.vec_id, v.label, list_distance(q.embedding::double[], v.embedding::double[]) as distance
    from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0))
"""

QUERIES = {
    "deck_aggregate": deck_aggregate, "deck_conflicts": deck_conflicts, "deck_order": part_order, "deck_export_rows": export_rows, "formula_neutralize": neutralize, "json_props": json_props,
    "text_fingerprint": fingerprints, "name_key_ascii": name_keys, "name_key_nfkc": name_keys_unicode, "money_format_parse": money, "kst_render": local_time, "html_extract": page_fields,
    "html_links_explode": page_links, "url_parts": url_parts, "knn_exact": knn, "ratio_vote": ratio_vote, "shared_vote_shortlist": shared_vote, "margin_decision": margin_decision,
    "mutual_match": mutual_match, "cells_recall": cells_recall, "softmax_topk": softmax_top, "greedy_suppression": suppression, "fingerprint_change": fingerprint_change,
}
AGGREGATE = """
a as (select l_partkey as cid, l_returnflag as rarity, sum(l_quantity)::bigint as quantity, count(*) as lines, arg_min((l_orderkey, l_suppkey, l_extendedprice), (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) as f from lineitem group by all)
"""
SQL = {
    "name_key_nfkc": f"""with a(form, alias) as (values {', '.join(f"('{k}', '{v}')" for k, v in names.ALIASES.items())}), f as (select [{', '.join(f"'{k}'" for k in names.ALIASES)}] as k),
        t as (select doc_id, case when doc_id % 50 = 0 then k[case doc_id // 50 % 11 when 10 then 4 else doc_id // 50 % 11 % 5 + 1 end] else replace(lower(nfc_normalize(text)), 'ß', 'ss') end as text from documents, f),
        s as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as key from t) select doc_id, coalesce(alias, key) as name_key from s left join a on form = key""",
    "deck_aggregate": f"with {AGGREGATE} select cid, rarity, quantity, lines, f[1] as l_orderkey, f[2] as l_suppkey from a",
    "deck_conflicts": "select l_partkey as cid, count(distinct l_returnflag) as variants from lineitem group by 1 having count(distinct l_returnflag) > 1",
    "deck_order": """with k as (select p_partkey, coalesce(list_position(['STANDARD', 'ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO'], p_type), 7) as k_group, p_size as k_level,
        case when p_size % 10 = 0 then -1 else round(p_retailprice)::bigint end as k_stat, case when p_partkey % 7 <> 0 then p_partkey % 100 end as k_passcode from part)
        select *, row_number() over (order by k_group, k_level desc, k_stat desc, k_passcode asc nulls last, p_partkey) as place from k""",
    "deck_export_rows": f"""with {AGGREGATE}, p as (select cid, p_name as name, rarity, quantity, case when rarity <> 'A' then round(f[3])::bigint end as unit_price from a left join part on p_partkey = cid)
        select *, unit_price * quantity as total from p""",
    "formula_neutralize": """with s as (select unnest([0, 1, 2, 3, 4, 5, 6, 7])::bigint as kind, unnest(['=', '+', '-', '@', chr(9), chr(13), '', 'a=']) as start), c as (select item_id, kind, start || text as t from benchmark cross join s)
        select item_id, kind, case when substr(t, 1, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then '''' || t else t end as cell from c""",
    "json_props": "with k as (select event_type, (props->>'$.k')::int as k from events) select event_type, count(k) as n, sum(k)::bigint as total, min(k) as least, max(k) as most from k group by 1",
    "text_fingerprint": "select sha256(text) as digest, count(*) as copies, min(doc_id) as first from documents group by 1",
    "name_key_ascii": """with k as (select p_partkey, lower(trim(regexp_replace(p_name || ' item', '[ \\t\\n\\r]+', ' ', 'g'))) as k, regexp_replace(p_name, '[ \\t\\n\\r]+', '', 'g') as compact from part)
        select p_partkey, case when k = 'small red item' then 'red item' else k end as name_key, compact from k""",
    "money_format_parse": "with v as (select p_partkey, round(p_retailprice * 1000)::bigint as value from part) select p_partkey, format('{:,}', value) as shown, value from v",
    "kst_render": "select event_id, strftime(ts + interval 9 hours, '%Y-%m-%d %H:%M') as kst from events",
    "html_extract": """select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, 'href="([^"]*)"'))::bigint as links, len(regexp_extract_all(html, '<[^>]*>'))::bigint as tags,
        octet_length(encode(html))::bigint as bytes from pages""",
    "html_links_explode": """with l as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as u from pages) select page_id, unnest(range(len(u))) as place, unnest(u) as url from l""",
    "url_parts": """select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query from pages""",
    "knn_exact": f"with {NEAR} select query, vec_id, round(distance, 6) as distance, place from near where place <= 8",
    "ratio_vote": f"""with {NEAR}, l as (select *, row_number() over (partition by query order by distance, label) as k from (select query, label, min(distance) as distance from near group by all))
        select query, min(label) filter (k = 1) as label, round(min(distance) filter (k = 1), 6) as first, round(min(distance) filter (k = 2), 6) as second, coalesce(min(distance) filter (k = 1) < 0.95 * min(distance) filter (k = 2), false) as distinctive from l group by query""",
    "shared_vote_shortlist": f"""with {NEAR}, n as (select * from near where place <= 8), f as (select query, min(distance) as d1 from n group by 1), c as (select distinct query, label from n join f using (query) where 0.95 * distance <= d1),
        s as (select query, 1.0::double / count(*) as share from c group by 1), v as (select label, sum(share) as votes from c join s using (query) group by 1), z as (select label, count(*) as size from embeddings group by 1)
        select label, round(votes, 6) as votes, round(votes / size, 8) as weighed from v join z using (label)""",
    "margin_decision": f"""with {NEAR}, v as (select query, query_label, label, count(*) as n from near where place <= 8 group by all), r as (select *, row_number() over (partition by query order by n desc, label) as k from v),
        t as (select query, query_label, max(label) filter (k = 1) as label, max(n) filter (k = 1) as votes, coalesce(max(n) filter (k = 2), 0) as next from r group by all)
        select *, round(votes / greatest(next, 1), 6) as margin, votes / greatest(next, 1) >= 2 as accepted from t""",
    "mutual_match": f"""with {NEAR}, f as (select query as a, vec_id as b, distance from near where place = 1),
        r as (select query as b, vec_id as a, row_number() over (partition by query order by distance, vec_id) as place from (
            select q.vec_id as query, v.vec_id, list_distance(q.embedding::double[], v.embedding::double[]) as distance from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id in (select b from f)))
        select a, b, round(distance, 6) as distance from f join r using (a, b) where place = 1""",
    "cells_recall": f"with {NEAR} select count(distinct query) as queries, count(*) as neighbours, true as enough from near where place <= 8",
    "softmax_topk": """with e as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double * 10 as x from embeddings), s as (select vec_id, i, exp(x - max(x) over (partition by vec_id)) as z from e),
        p as (select vec_id, i, z / sum(z) over (partition by vec_id) as p from s), r as (select *, row_number() over (partition by vec_id order by p desc, i) as k from p)
        select vec_id, max(i) filter (k = 1) as top1, max(i) filter (k = 2) as top2, max(i) filter (k = 3) as top3, round(max(p) filter (k = 1), 6) as p1, max(p) filter (k = 1) < 0.5 or max(p) filter (k = 1) - max(p) filter (k = 2) < 0.1 as review from r where k <= 3 group by vec_id""",
    "greedy_suppression": """with recursive ranked as (select user_id, event_id as id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as b, value * 60 as len,
          row_number() over (partition by user_id order by value desc nulls last, event_id) as rn from events),
        fold(user_id, rn, kept) as (select distinct user_id, 0::bigint, []::struct(id bigint, b double, e double)[] from events
          union all select f.user_id, r.rn, case when len(list_filter(kept, lambda k: least(k.e, b + r.len) - greatest(k.b, b) > 0 and least(k.e, b + r.len) - greatest(k.b, b) > 0.5 * (r.len + k.e - k.b - (least(k.e, b + r.len) - greatest(k.b, b))))) = 0
            then list_append(kept, struct_pack(id := id, b := b, e := b + r.len)) else kept end from fold f join ranked r on r.user_id = f.user_id and r.rn = f.rn + 1),
        done as (select user_id, arg_max(kept, rn) as kept from fold group by 1)
        select user_id, unnest(list_transform(kept, lambda k: k.id)) as id from done""",
    "fingerprint_change": """with m as (select conv_id, turn, md5(concat_ws('|', role, text)) as digest from conversations) select conv_id, turn, digest, coalesce(lag(digest) over (partition by conv_id order by turn) <> digest, true) as changed from m""",
}

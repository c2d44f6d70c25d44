"""Nested records, stores, digests, constraints and the deck's order over the stand-in tables, with their SQL."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import assets, deck, digests, history, identity, layout, names, nested, publish
from ..operators.constraints import Constraints, violations
from ..operators.numbering import stored
from ..operators.suppression import bounds, meeting
from ..sources.tables import dealt, fresh_folder, moment, table
from . import shop, texts
from .official import joined


def indexes(spark: SparkSession, d: str, torn: bool) -> DataFrame:
    """A reference index for each order: its parts as cards, their lines as artworks; with faults of shape (`torn`) or of content."""
    k, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    sha = F.sha2(joined(order, ":", line).cast("binary"), 256)
    image = joined("images/", F.when((k % 127 == 0) & (not torn), 0).otherwise(k), "_", line, "_", F.substring(sha, 1, 12), ".png")
    art = F.struct(line.alias("ciid"), image.alias("image"), F.when((line != 7) | (not torn), sha).alias("sha256"))
    arts = F.to_json(F.array_sort(F.collect_list(art)), {"ignoreNullFields": "false"})
    cards = dealt(table(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(arts.alias("arts"))
    cid = F.when((k % 107 == 0) & torn, joined('"', k, '"')).when((k % 131 == 0) & (not torn), "0").otherwise(k.cast("string"))
    name = F.when((k % 103 == 0) & torn, "").when((k % 109 == 0) & (not torn), '"name_en":" ",').otherwise(joined('"name_en":"Card ', k, '",'))
    url = F.when((k % 113 == 0) & (not torn), "x").otherwise(joined("/card?cid=", k))
    card = joined('"', k, '":{"cid":', cid, ',"name_ja":null,', name, '"name_ko":null,"source_url":"', url, '","artworks":', F.col("arts"), F.when((k % 101 == 0) & torn, ',"extra":{"a":[1]}').otherwise(""), "}")
    docs = cards.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(card)), ",").alias("cards"))
    head = F.when((order % 97 == 0) & torn, "").when((order % 97 == 0), '"schema":2,').otherwise('"schema":1,')
    return docs.select("l_orderkey", joined("{", head, '"cards":{', F.col("cards"), F.when((order % 211 == 0) & torn, "}").otherwise("}}")).alias("doc"))


def index_faults(spark: SparkSession, d: str) -> DataFrame:
    return nested.faults(indexes(spark, d, True), ["l_orderkey"], "doc", nested.INDEX)


def index_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.index_cards(indexes(spark, d, False), ["l_orderkey"], "doc", joined("/card?cid=", F.col("card")))
    return rows.select("l_orderkey", "card", F.size("artworks").cast("long").alias("artworks"), "problem")


def cached_names(spark: SparkSession, d: str) -> DataFrame:
    """A name cache for each size of part, whose entries' names, addresses or numbers are wrong here and there."""
    k = F.col("p_partkey")
    entry = F.struct(F.when(k % 31 == 0, -1).otherwise(k).alias("cid"), F.lit(None).cast("string").alias("name_ko"), F.lit(None).cast("string").alias("name_ja"), joined(F.when(k % 29 == 0, "Other ").otherwise("Card  "), k).alias("name_en"), joined("/card?cid=", F.when(k % 37 == 0, 0).otherwise(k)).alias("source_url"), joined("images/", k, ".png").alias("image_path"))
    docs = table(spark, d, "part").groupBy("p_size").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(joined("card ", k).alias("key"), entry.alias("value")))), {"ignoreNullFields": "false"}).alias("doc"))
    found = nested.faults(docs, ["p_size"], "doc", nested.CACHE)
    sound = docs.join(found.select("p_size").distinct(), "p_size", "left_anti")
    name = F.lower(F.regexp_replace("name_en", " +", " "))
    return nested.cached_cards(sound, ["p_size"], "doc", name, joined("/card?cid=", F.col("cid"))).select("p_size", "card", "cid", "problem")


def _filled(spark: SparkSession, d: str):
    """All texts as artworks, three a card; then every fifth card once more, as other images."""
    content = lambda magic: F.concat(F.unhex(F.lit(magic)), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content")
    rows = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("cid"), (F.col("doc_id") % 3 + 1).alias("ciid"), "text")
    ledger = assets.store(spark, fresh_folder(spark, "assets"))
    assets.upsert(ledger, rows.select("cid", "ciid", content("89504E470D0A1A0A")))
    assets.upsert(ledger, rows.where("cid % 5 = 0").select("cid", "ciid", content("FFD8FF")))
    return ledger


def asset_index(spark: SparkSession, d: str) -> DataFrame:
    ledger = _filled(spark, d)
    seen, _ = assets.sweep(ledger)
    return ledger.read("artworks", seen).join(assets.audit(ledger, seen).select("sha256", "state"), "sha256").select("cid", "ciid", "image", "sha256", "state")


def asset_states(spark: SparkSession, d: str) -> DataFrame:
    """The contents before a sweep."""
    ledger = _filled(spark, d)
    return assets.audit(ledger, ledger.head())


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    new = table(spark, d, "part").withColumn("p_size", F.when(k % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).where(k % 89 != 0)
    more = new.where(k % 83 == 0).withColumn("p_partkey", -k - 1)
    return digests.changes(table(spark, d, "part"), new.unionByName(more), ["p_partkey"])


def prefix_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return digests.merged(digests.leaves(rows, ["doc_id"]), 1).select("prefix", F.col("rows").cast("long").alias("rows"), *[F.col(c).cast("string").alias(c) for c in ("a", "b")])


def constraint_findings(spark: SparkSession, d: str) -> DataFrame:
    """A batch of every fifth order, of which every other is stored already and some come twice, with customers that aren't all known."""
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    batch = orders.where(k % 5 == 0).unionByName(orders.where(k % 50 == 0))
    known = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    rules = Constraints([["o_orderkey"], ["o_custkey", "o_orderdate", "o_orderkey"]], {"customer": (["o_custkey"], known, ["c_custkey"])}, {"price": F.col("o_totalprice") > 2000, "date": F.col("o_orderdate").isNotNull()})
    return violations(batch, orders.where(k % 10 != 0), rules)


def sorted_deck(spark: SparkSession, d: str) -> DataFrame:
    """The deck in the order of its cards' texts, of those that can be read."""
    cards = stored(deck.species_order(shop.card_texts(spark, d).withColumnRenamed("p_partkey", "cid")), "cards")
    sound = cards.where("problem is null").select("cid")
    own = deck.aggregate(texts.entries(spark, d), ["cid", "rarity"], "l_quantity", texts.FIRST, ["l_orderkey"]).join(sound, "cid", "left_semi")
    return deck.sorted_deck(own, cards, ("R", "A", "N")).select("cid", "rarity", "quantity", "place")


def searched_names(spark: SparkSession, d: str) -> DataFrame:
    """Result pages of three rows, for each seven parts in a row: their first words, with the number of the seven, are searched for, and one
    name that none has. Some searches lack their last page or have a torn one."""
    k, g = F.col("p_partkey"), F.expr("p_partkey div 7")
    word = F.concat_ws(" ", F.substring_index("p_name", " ", 1), g.cast("string"))
    rows = table(spark, d, "part").select(g.alias("g"), k, word.alias("name"))
    group = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(k.alias("cid"), F.upper("name").alias("name")))).alias("cards"), F.count("*").alias("total"))
    pages = group.select("g", "total", "cards", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("total") / 3), F.lit(1)).cast("int"))).alias("page"))
    pages = pages.where(~((F.col("g") % 13 == 0) & (F.col("page") == 3))).select("g", "page", "total", F.slice("cards", (F.col("page") - 1) * 3 + 1, 3).alias("cards"), F.when((F.col("g") % 17 == 0) & (F.col("page") == 2), "no rows").alias("problem"))
    wanted = rows.select("g", "name").distinct().unionByName(rows.select("g", F.concat(F.lit("none "), F.col("g").cast("string")).alias("name")).distinct())
    found = names.exact_ids(wanted.join(pages, "g").select(F.col("name").alias("wanted"), "page", "total", "cards", "problem"), "wanted", F.lower("c.name"), 3)
    return found


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """The names searched for, of which some are in the cache, soundly or not, and some aren't searched yet; some detail pages are another's."""
    found = stored(searched_names(spark, d), "found").withColumnRenamed("wanted", "key")
    number = F.element_at(F.split("key", " "), 2).cast("long")
    cached = found.where((number % 3 == 0) & ~F.startswith("key", F.lit("none"))).select("key", number.alias("cid"), F.when(number % 9 == 0, "name").alias("problem"))
    details = found.where("cid is not null").select("cid", F.when(F.col("cid") % 5 == 0, "other").otherwise(F.col("key")).alias("key"), F.when(F.col("cid") % 31 == 0, "heading").alias("problem"))
    return names.resolved(found, cached, found.where(number % 4 != 0).select("key", "cid", "problem"), details)


def queryable(spark: SparkSession, d: str) -> DataFrame:
    """The Japanese numbers of two finishes of each part."""
    number = F.concat(F.lit("AB"), (F.col("l_suppkey") % 90 + 10).cast("string"), F.lit("-"), F.when(F.col("l_orderkey") % 3 == 0, "KR").when(F.col("l_orderkey") % 3 == 1, "JP").otherwise("jp"), F.lpad((F.col("l_linenumber") * 7).cast("string"), 3, "0"))
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("rid"), number.alias("number"))
    good = F.col("number").rlike("^[0-9A-Z]{2,6}-JP[A-Z]{0,2}[0-9]{2,3}$")
    return names.queryable_numbers(rows, ["l_partkey"], "number", "rid", [1, 3], good).select("l_partkey", F.array_join("numbers", ",").alias("numbers"))


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's likeliest component as a label, and whether it is likely enough."""
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("top1"), F.col("p_name").alias("label"))
    rows = texts.softmax_top(spark, d).select("vec_id", "top1", F.when(F.col("p1") >= 0.5, "recognized").otherwise("review").alias("status"))
    return names.labelled(rows, labels, "top1")


def placed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' records have the parts of their first lines as ids; parts are the labels to be placed."""
    rows = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("record")).agg(F.collect_list("l_partkey").alias("ids"))
    return identity.records_of_ids(rows, table(spark, d, "part").select(F.col("p_partkey").alias("label")))


def outside_lists(spark: SparkSession, d: str) -> DataFrame:
    """Customers that orders are placed on and that the list of two in three lacks."""
    return identity.outside(table(spark, d, "orders").select(F.col("o_custkey").alias("cid")), table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("cid")), "cid")


def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    """Parts in two locales by flag: lists, prints and claims made from different lines, so that they disagree."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"), F.col("l_linestatus").alias("locale"), "l_returnflag", "l_linenumber")
    listed = rows.where("l_linenumber <= 3").select("cid", "locale").distinct()
    claims = rows.where("l_linenumber in (1, 4)").groupBy("cid", "locale").agg(F.when(F.min("l_returnflag") == "A", "printed").otherwise("no_printing").alias("coverage"))
    return identity.coverage_audit(claims, rows.where("l_returnflag = 'A'"), listed, "cid", "locale")


def unusable_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Users' purchases as observations: why a user's last one can't be used, among users of twice the number."""
    events = table(spark, d, "events")
    wanted = events.select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 100)).alias("user_id"))
    as_of = moment("2024-01-30 12:00:00")
    return history.unusable(wanted, events.where("event_type = 'purchase'"), ["user_id"], "ts", as_of).select("user_id", "why", F.col("turn").cast("long").alias("turn"))


def resumed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages to fetch, of which two in three have a checkpoint, some twice, torn, or of another brand."""
    now = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    k = F.col("p_partkey")
    old = now.where(k % 3 != 0).withColumn("p_brand", F.when(k % 7 == 0, "none").otherwise(F.col("p_brand"))).withColumn("torn", F.when(k % 11 == 0, "row"))
    return history.resumed(now, old.unionByName(old.where(k % 13 == 0)), "p_partkey", ["p_brand", "p_size"], F.col("torn"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of upright boxes on a photo a user and day that meet: what they share of both and of the smaller."""
    b = shop.boxes(spark, d)
    points = [F.array(F.col("cx") + x * F.col("w") / 2, F.col("cy") + y * F.col("h") / 2) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    polygon = F.array(*points)
    items = b.select("user_id", "day", F.col("event_id").alias("id"), polygon.alias("polygon"), *[c.alias(n) for n, c in bounds(polygon).items()])
    pairs = meeting(items, ["user_id", "day"], layout.AXES).select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), F.col("a_polygon").alias("a"), F.col("b_polygon").alias("b"))
    found = layout.overlaps(pairs).where("iou > 0")
    return found.select("i", "j", F.round("iou", 6).alias("iou"), F.round("of_smaller", 6).alias("of_smaller"))


def export_names(spark: SparkSession, d: str) -> DataFrame:
    """A part's name in an export: what was entered for it, unless blank, or else the official one."""
    k = F.col("p_partkey")
    entered = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit(" mine "), k.cast("string"), F.lit(" "))).when(k % 4 == 2, "")
    return table(spark, d, "part").select(k, scalars.first_text(entered, F.col("p_name")).alias("name"))


def published_tables(spark: SparkSession, d: str) -> DataFrame:
    """What is read after three publications, of which an audit stops the second: orders by customer and the customers, one version."""
    folder = fresh_folder(spark, "published")
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orphans = lambda o, c: {"orphans": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")}
    half, some = customers.where("c_custkey % 2 = 0"), orders.where("o_custkey % 2 = 0")
    publish.publish({"orders": some, "customers": half}, orphans(some, half), folder)
    with contextlib.suppress(ValueError):
        publish.publish({"orders": orders, "customers": half}, orphans(orders, half), folder)
    stopped = publish.published(spark, folder).number
    publish.publish({"orders": orders, "customers": customers}, orphans(orders, customers), folder)
    seen = publish.published(spark, folder)
    read = [publish.current(spark, folder, name, seen) for name in ("orders", "customers")]
    return read[0].join(read[1], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.lit(stopped).alias("version_before"), F.lit(seen.number).alias("version"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as spreadsheet-safe CSV and read back."""
    k, folder = F.col("p_partkey"), fresh_folder(spark, "csv")
    name = F.when(k % 5 == 0, F.concat(F.lit("="), F.col("p_name"))).when(k % 5 == 1, F.concat(F.col("p_name"), F.lit(', "é"'))).when(k % 5 != 2, F.col("p_name"))
    publish.write_csv(table(spark, d, "part").select(name.alias("name"), k, "p_size"), folder)
    rows = spark.read.option("header", True).csv(folder)
    return rows.toDF("name", "p_partkey", "p_size").select("name", F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"))


QUERIES = {
    "box_overlaps": box_overlaps, "export_names": export_names, "published_tables": published_tables, "csv_round_trip": csv_round_trip,
    "placed_labels": placed_labels, "outside_lists": outside_lists, "coverage_findings": coverage_findings, "unusable_numbers": unusable_numbers, "resumed_pages": resumed_pages,
    "searched_names": searched_names, "resolved_names": resolved_names, "queryable_numbers": queryable, "candidate_labels": candidate_labels,
    "index_faults": index_faults, "index_cards": index_cards, "cached_names": cached_names, "asset_index": asset_index, "asset_states": asset_states, "changed_rows": changed_rows,
    "prefix_digests": prefix_digests, "constraint_findings": constraint_findings, "sorted_deck": sorted_deck,
}
CONTENTS = r"""c as (select doc_id // 3 as cid, doc_id % 3 + 1 as ciid, '\x89PNG\x0D\x0A\x1A\x0A'::blob || encode(coalesce(text, '')) as png, '\xFF\xD8\xFF'::blob || encode(coalesce(text, '')) as jpg from documents)"""
WRITTEN = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
FOUND = """p as (select p_partkey // 7 as g, p_partkey as cid, split_part(p_name, ' ', 1) || ' ' || (p_partkey // 7) as name from part), n as (select g, count(*) as total from p group by 1),
        w as (select g, name, count(*) as n, min(cid) as c from p group by all union all select g, 'none ' || g, 0, null from n),
        f as (select name as wanted, g, n as found, c, case when g % 17 = 0 and total > 3 then 'no rows' when g % 13 = 0 and total > 6 then 'missing page' when n = 0 then 'unknown' when n > 1 then 'ambiguous' end as problem, total from w join n using (g)),
        s as (select g, cid, name, row_number() over (partition by g order by cid) as nth from p),
        r as (select wanted, case when problem is null then c end as cid, case when g % 13 = 0 and total > 6 then (select count(*) from s where s.g = f.g and s.name = f.wanted and nth <= 6) else found end as found, problem from f)"""
SQL = {
    "box_overlaps": """with b as (select event_id as i, user_id, ts::date as day, (event_id * 37 % 400)::double as x, (event_id * 53 % 300)::double as y, (event_id * 11 % 60 + 20) / 2.0::double as w, (event_id * 17 % 80 + 21) / 2.0::double as h from events),
        p as (select a.i, b.i as j, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x - a.w, b.x - b.w), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y - a.h, b.y - b.h), 0) as shared, 4 * a.w * a.h as s, 4 * b.w * b.h as t from b a join b b on a.user_id = b.user_id and a.day = b.day and a.i < b.i)
        select i, j, round(shared / (s + t - shared), 6) as iou, round(shared / least(s, t), 6) as of_smaller from p where shared > 0""",
    "export_names": "select p_partkey, case when p_partkey % 4 = 1 then 'mine ' || p_partkey else p_name end as name from part",
    "published_tables": "select c_nationkey, count(*) as orders, 1 as version_before, 2 as version from orders join customer on o_custkey = c_custkey group by 1",
    "csv_round_trip": """select case p_partkey % 5 when 0 then chr(39) || '=' || p_name when 1 then p_name || ', "é"' when 2 then null else p_name end as name, p_partkey, p_size from part""",
    "placed_labels": """with r as (select distinct l_suppkey as record, l_partkey as label from lineitem where l_linenumber = 1), h as (select label, min(record) as one, count(*) as n from r group by 1)
        select p_partkey as label, case when n = 1 then one end as record, coalesce(n, 0) as records, case when n is null then 'unplaced' when n > 1 then 'ambiguous' end as finding from part left join h on label = p_partkey""",
    "outside_lists": "select distinct o_custkey as cid from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0)",
    "coverage_findings": """with k as (select distinct l_partkey as cid, l_linestatus as locale from lineitem), s as (select l_partkey as cid, l_linestatus as locale, bool_or(l_linenumber <= 3) as listed, bool_or(l_returnflag = 'A') as printed,
          min(l_returnflag) filter (l_linenumber in (1, 4)) as claim from lineitem group by all),
        f as (select cid, locale, case when not listed then case when printed or claim is not null then 'not listed' end when claim is null then 'not covered' when claim = 'A' and not printed then 'no prints' when claim <> 'A' and printed then 'has prints' end as finding from s)
        select * from f where finding is not null""",
    "unusable_numbers": """with w as (select user_id from events union select user_id + 100 from events), l as (select user_id, max(ts) as t from events where event_type = 'purchase' group by 1),
        s as (select user_id, case when t is null then 'never stored' when t > timestamp '2024-01-30 12:00:00' then 'future' when t + interval 12 hour <= timestamp '2024-01-30 12:00:00' then 'expired' end as why from w left join l using (user_id))
        select *, case why when 'expired' then 0 when 'never stored' then 1 end::bigint as turn from s""",
    "resumed_pages": """select p_partkey, case when p_partkey % 3 = 0 then 'fetch' when p_partkey % 13 = 0 or p_partkey % 11 = 0 then 'broken' when p_partkey % 7 = 0 then 'fetch' else 'reuse' end as action,
        case when p_partkey % 3 <> 0 and p_partkey % 11 = 0 then 'row' end as fault from part""",
    "searched_names": f"with {FOUND} select * from r",
    "resolved_names": f"""with {FOUND}, q as (select *, split_part(wanted, ' ', 2)::bigint as i from r), h as (select *, i % 3 = 0 and not wanted like 'none%' as hit, i % 4 <> 0 as asked from q),
        j as (select *, case when hit then case when i % 9 = 0 then 'name' end when not asked then 'to search' when problem is not null then problem when cid % 31 = 0 then 'heading' when cid % 5 = 0 then 'other name' end as fault from h)
        select wanted as key, case when fault is null then case when hit then i else cid end end as cid, case when hit then 'cache' when asked then 'search' end as source, fault as problem, fault is null and not hit as keep from j""",
    "queryable_numbers": """select l_partkey, array_to_string(list_sort(list_distinct(list('AB' || (l_suppkey % 90 + 10) || '-JP' || lpad((l_linenumber * 7)::varchar, 3, '0')))), ',') as numbers from lineitem where l_linenumber in (1, 3) and l_orderkey % 3 = 1 group by 1""",
    "candidate_labels": f"""with t as ({texts.SQL["softmax_topk"]}) select vec_id, top1, case when p1 >= 0.5 then 'recognized' else 'review' end as status, p_name as label from t join part on p_partkey = top1""",
    "index_faults": """with c as (select l_orderkey as o, l_partkey as k, array_agg(l_linenumber order by l_linenumber) as lines from lineitem group by all), s as (select * from c where o % 211 <> 0)
        select distinct o as l_orderkey, '$' as path, 'not JSON' as fault from c where o % 211 = 0
        union all select distinct o, '$.schema', 'missing' from s where o % 97 = 0
        union all select o, '$.cards.' || k || '.extra', 'unknown' from s where k % 101 = 0
        union all select o, '$.cards.' || k || '.name_en', 'missing' from s where k % 103 = 0
        union all select o, '$.cards.' || k || '.cid', 'type' from s where k % 107 = 0
        union all select o, '$.cards.' || k || '.artworks.' || (i - 1) || '.sha256', 'type' from (select o, k, lines, unnest(range(1, len(lines) + 1)) as i from s) where lines[i] = 7""",
    "index_cards": """select l_orderkey, l_partkey::varchar as card, count(*) as artworks, case when l_orderkey % 97 = 0 then 'schema' when l_partkey % 131 = 0 or l_partkey <= 0 then 'cid' when l_partkey % 109 = 0 then 'name' when l_partkey % 113 = 0 then 'address'
        when count(distinct l_linenumber) < count(*) then 'artwork' when l_partkey % 127 = 0 then 'image' end as problem from lineitem group by l_orderkey, l_partkey""",
    "cached_names": """select p_size, 'card ' || p_partkey as card, case when p_partkey % 31 = 0 then -1 else p_partkey end as cid, case when p_partkey % 31 = 0 or p_partkey <= 0 then 'cid' when p_partkey % 29 = 0 then 'name' when p_partkey % 37 = 0 then 'address' end as problem from part""",
    "asset_index": f"""with {CONTENTS}, r as (select cid, ciid, sha256(case when cid % 5 = 0 then jpg else png end) as sha256 from c)
        select cid, ciid, format('images/{{}}_{{}}_{{}}.{{}}', cid, ciid, sha256[1:12], case when cid % 5 = 0 then 'jpg' else 'png' end) as image, sha256, 'live' as state from r""",
    "asset_states": f"""with {CONTENTS}, e as (select sha256(png) as sha256, case when cid % 5 = 0 then 0 else 1 end as n from c union all select sha256(jpg), 1 from c where cid % 5 = 0)
        select sha256, case when sum(n) > 0 then 'live' else 'garbage' end as state, sum(n)::bigint as artworks from e group by 1""",
    "changed_rows": """select p_partkey, case when p_partkey % 89 = 0 then 'removed' else 'changed' end as change from part where p_partkey % 89 = 0 or p_partkey % 97 = 0 union all select -p_partkey - 1, 'added' from part where p_partkey % 83 = 0 and p_partkey % 89 <> 0""",
    "prefix_digests": f"""with r as (select md5({WRITTEN('doc_id')})[1:1] as prefix, sha256({' || '.join(map(WRITTEN, ('doc_id', 'lang', 'source', 'text')))}) as h from documents)
        select prefix, count(*) as rows, sum(('0x' || h[1:15])::bigint)::hugeint::varchar as a, sum(('0x' || h[16:30])::bigint)::hugeint::varchar as b from r group by 1""",
    "constraint_findings": """with b as (select * from orders where o_orderkey % 5 = 0 union all select * from orders where o_orderkey % 50 = 0)
        select 'unique o_orderkey' as constraint, o_orderkey::varchar as key, count(*) as rows from b group by o_orderkey having count(*) > 1 or o_orderkey % 10 <> 0
        union all select 'unique o_custkey, o_orderdate, o_orderkey', concat_ws(',', o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey), count(*) from b group by o_custkey, o_orderdate, o_orderkey having count(*) > 1 or o_orderkey % 10 <> 0
        union all select 'reference customer', o_custkey::varchar, count(*) from b where o_custkey not in (select c_custkey from customer where c_custkey % 7 <> 0) group by o_custkey
        union all select 'check price', null, count(*) from b where not o_totalprice > 2000 having count(*) > 0""",
    "sorted_deck": f"""with s as ({shop.SQL["species_order"]}), a as (select l_partkey as cid, l_returnflag as rarity, sum(l_quantity)::bigint as quantity from lineitem group by all)
        select cid, rarity, quantity, row_number() over (order by "group", subtype, level desc, atk desc, def desc, case when cid % 6 <> 0 then cid + 1 end nulls last, cid, list_position(['R', 'A', 'N'], rarity)) as place
        from a join s on p_partkey = cid where problem is null""",
}

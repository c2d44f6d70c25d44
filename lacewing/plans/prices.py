"""Price and history queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, pricing
from ..operators.numbering import stored
from ..sources.tables import latest, moment, spread, table

KEYS = ["user_id", "event_type"]


def listings(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Items with their order's label, if `dealt` by order in parts of a bounded size."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    items = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("edition"), (F.col("l_suppkey") % 4).alias("number"), F.col("l_linenumber").alias("rid"), F.col("l_orderkey").alias("product"),
        F.round("l_extendedprice").cast("long").alias("price"), F.when(F.col("l_returnflag") == "N", "in_stock").when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("unknown").alias("stock"), F.col("l_shipdate").alias("observed"),
    )
    if dealt:
        n = table(spark, d, "lineitem").count()
        items, orders = spread(items, n, "product"), spread(orders, n, "o_orderkey")
    return items.join(orders, F.col("product") == F.col("o_orderkey")).drop("o_orderkey")


def price_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    as_of = moment(latest(table(spark, d, "lineitem"), "l_shipdate")) - F.expr("INTERVAL 30 DAYS")
    return pricing.select_prices(rows.select("part", "edition", "number", "rid"), rows.drop("rid"), as_of, "INTERVAL 2100 DAYS")


LISTINGS = """
listings as (
  select l_partkey as part, l_linestatus as edition, l_suppkey % 4 as number, l_linenumber as rid, l_orderkey as product, round(l_extendedprice)::bigint as price,
    case l_returnflag when 'N' then 'in_stock' when 'R' then 'out_of_stock' else 'unknown' end as stock, l_shipdate as observed, o_orderpriority as label
  from lineitem join orders on l_orderkey = o_orderkey
), prints as (
  select distinct part, edition, number, rid from listings
), family(label, member) as (
  values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('3-MEDIUM', 4), ('5-LOW', 5), ('5-LOW', 6), ('5-LOW', 7)
)"""

PRICE_SELECTION = f"""
with {LISTINGS}, labelled as (
  select part, edition, number, label, count(*) as n, min(rid) as only_rid from (select distinct part, edition, number, label from listings) join prints using (part, edition, number) join family using (label)
  where rid = member group by all
), pool as (
  select l.part, l.edition, l.number, product, price, stock, observed, case when n = 1 then only_rid end as mapped from listings l left join labelled using (part, edition, number, label)
), clk as (
  select max(l_shipdate) - interval 30 days as t from lineitem
), seen as (
  select p.rid, o.* from prints p join pool o using (part, edition, number)
), per as (
  select part, edition, rid, bool_or(observed > t) as future, bool_or(observed + interval 2100 days <= t) as stale, count(*) filter (mapped = rid) as matched,
    count(*) filter (mapped = rid and stock = 'in_stock') as in_stock, count(*) filter (mapped is null) as unverified, min(observed) + interval 2100 days as expires from seen, clk group by part, edition, rid
), best as (
  select * from (select part, edition, rid, price, stock, row_number() over (partition by part, edition, rid order by (stock <> 'in_stock')::int, price, number, product, stock) as k from seen where mapped = rid) where k = 1
), named as (
  select per.*, best.price as best_price, case when future then 'data_error' when stale then 'expired'
    when matched > 0 then case stock when 'in_stock' then 'ok' when 'out_of_stock' then 'out_of_stock' else 'stock_unknown' end when unverified > 0 then 'unverified' else 'not_observed' end as status
  from per left join best using (part, edition, rid)
)
select part, edition, rid, status, case when status in ('ok', 'out_of_stock', 'stock_unknown') then best_price end as price, matched, in_stock, unverified, expires from named
"""


def label_map(spark: SparkSession, d: str) -> DataFrame:
    """Rids are bits in the order of `pricing.RIDS`: what a number prints is a number itself, and no row holds a list."""
    key = ["part", "edition", "number"]
    pool = stored(listings(spark, d, dealt=True).groupBy(*key, "product", "label").agg(F.bit_or(pricing.rid_bit(F.col("rid"))).alias("own")), "pool")
    dealt = spread(pool, pool.count(), *key).withColumn("printed", F.bit_or("own").over(Window.partitionBy(*key)))
    both = pricing.family_bits(F.col("label")).bitwiseAND(F.col("printed"))
    return dealt.select(*key, "product", "label", F.bit_count(pricing.family_bits(F.col("label"))).cast("long").alias("family_size"), F.bit_count(both).cast("long").alias("shared"), pricing.only_rid(both).alias("mapped"))


LABEL_MAP = f"""
with {LISTINGS}, one as (select distinct part, edition, number, product, label from listings)
select part, edition, number, product, o.label, (select count(*) from family f where f.label = o.label) as family_size,
  count(rid) as shared, case when count(rid) = 1 then min(rid) end as mapped
from one o left join (select p.*, label from prints p join family on rid = member) s using (part, edition, number, label) group by all
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def latest_per_product(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_per_key(events(spark, d), KEYS, ["ts", "event_id"])


LATEST = "select user_id, event_type, event_id, ts, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events {0}) where k = 1"


def latest_bounded(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return history.latest_per_key(rows, KEYS, ["ts", "event_id"], F.col("event_id") <= latest(rows, "event_id") // 2)


def group_revision(spark: SparkSession, d: str) -> DataFrame:
    return history.revision(events(spark, d), KEYS, "event_id")


def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return history.freshness(rows, KEYS, "ts", moment(latest(rows, "ts")) - F.expr("INTERVAL 1 DAY"))


def group_expiry(spark: SparkSession, d: str) -> DataFrame:
    return history.group_expiry(events(spark, d), KEYS, "ts")


def late_arrival(spark: SparkSession, d: str) -> DataFrame:
    """The last by event time beside the last by a shuffled arrival: an older event that comes later replaces nothing."""
    rows = events(spark, d).withColumn("arrival", F.md5(F.col("event_id").cast("string").cast("binary")))
    return rows.groupBy(*KEYS).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("by_event_time"), F.max_by("event_id", "arrival").alias("by_arrival"))


def attempt_state(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return history.attempt_gate(rows, "user_id", "ts", "event_id", "event_type", moment(latest(rows, "ts")))


def collection_work_list(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    kinds = rows.agg(F.array_sort(F.collect_set("event_type"))).scalar()
    wanted = rows.select("user_id").distinct().withColumn("kinds", kinds).select("user_id", F.explode("kinds").alias("event_type"))
    recent = rows.where(F.col("ts") > moment(latest(rows, "ts")) - F.expr("INTERVAL 7 DAYS"))
    return history.work_list(wanted, recent, rows, KEYS, "ts")


def idempotent_import(spark: SparkSession, d: str) -> DataFrame:
    """A batch that holds the stored orders again, some of them changed, and new ones."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    stored = orders.where("o_orderkey % 3 > 0").withColumn("digest", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256))
    batch = orders.withColumn("digest", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 1, "X").otherwise(F.col("o_orderstatus"))), 256))
    return history.append_new(batch, stored, ["o_orderkey"], "digest").select("o_orderkey", "digest", "action")


def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d, F.col("gap") > 12 * 3600 * 10**6)


def median_gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d, F.col("gap") > 0.5 * F.col("usual"))


def _islands(spark: SparkSession, d: str, starts) -> DataFrame:
    rows = history.islands(events(spark, d), "user_id", "ts", "event_id", starts)
    return rows.groupBy("user_id", "island").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("members"))


ISLANDS = """
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events),
m as (select *, median(gap) over (partition by user_id) as usual from g),
i as (select *, (sum(case when {0} then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) + 1)::bigint as island from m)
select user_id, island, min(ts) as begins, max(ts) as ends, count(*) as members from i group by user_id, island
"""

QUERIES = {
    "price_selection": price_selection, "label_map_unique_match": label_map, "latest_per_product": latest_per_product, "latest_bounded_by_revision": latest_bounded, "group_revision": group_revision,
    "freshness_status": freshness_status, "group_expiry": group_expiry, "late_arrival_check": late_arrival, "attempt_state": attempt_state, "collection_worklist": collection_work_list,
    "idempotent_import": idempotent_import, "gap_islands": gap_islands, "row_grouping_median_gap": median_gap_islands,
}
SQL = {
    "price_selection": PRICE_SELECTION,
    "label_map_unique_match": LABEL_MAP,
    "latest_per_product": LATEST.format(""),
    "latest_bounded_by_revision": LATEST.format("where event_id <= (select max(event_id) // 2 from events)"),
    "group_revision": "select user_id, event_type, max(event_id) as revision from events group by all",
    "freshness_status": """
        with clk as (select max(ts) - interval 1 day as t from events), g as (select user_id, event_type, max(ts) as last, min(ts) as first from events group by all)
        select user_id, event_type, last, case when last > t then 'future' when last + interval 12 hours <= t then 'expired' else 'fresh' end as status, first <= t and first + interval 12 hours > t as all_fresh from g, clk""",
    "group_expiry": "select user_id, event_type, min(ts) + interval 12 hours as expires_at, count(*) as members from events group by user_id, event_type",
    "late_arrival_check": """
        select user_id, event_type, arg_max(event_id, (ts, event_id)) as by_event_time, arg_max(event_id, md5(event_id::varchar)) as by_arrival from events group by user_id, event_type""",
    "attempt_state": """
        with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), clk as (select max(ts) as t from events),
        s as (select user_id, ts as since, case event_type when 'purchase' then 'stored' when 'error' then 'failed' when 'signup' then 'empty' else 'pending' end as state from l where k = 1)
        select user_id, state, since, state <> 'failed' and not (state = 'empty' and since + interval 12 hours > t) as request_allowed from s, clk""",
    "collection_worklist": """
        with w as (select user_id, event_type from (select distinct user_id from events), (select distinct event_type from events)),
        r as (select distinct user_id, event_type from events where ts > (select max(ts) - interval 7 days from events)), o as (select user_id, event_type, max(ts) as last from events group by all)
        select user_id, event_type, case when last is null then 1 else 0 end as priority, last from w anti join r using (user_id, event_type) left join o using (user_id, event_type)""",
    "idempotent_import": """
        with s as (select o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) as known from orders where o_orderkey % 3 > 0),
        b as (select o_orderkey, sha256(o_orderkey || '|' || case when o_orderkey % 10 = 1 then 'X' else o_orderstatus end) as digest from orders)
        select o_orderkey, digest, case when known is null then 'new' when known = digest then 'unchanged' else 'conflict' end as action from b left join s using (o_orderkey)""",
    "gap_islands": ISLANDS.format("gap > 43200000000"),
    "row_grouping_median_gap": ISLANDS.format("gap > 0.5 * usual"),
}

"""Catalogue, coverage and audit queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, identity, quality
from ..sources.tables import table

LOCALES = ["F", "O", "P"]


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cid"), F.col("o_orderstatus").alias("locale")).agg(F.min("o_orderkey").cast("string").alias("name"))


def locale_union(spark: SparkSession, d: str) -> DataFrame:
    rows = names(spark, d)
    return identity.locale_union({x: rows.where(F.col("locale") == x) for x in LOCALES}, "cid")


def locale_union_pivot(spark: SparkSession, d: str) -> DataFrame:
    return identity.locale_pivot(names(spark, d), "cid", "locale", LOCALES)


UNION = """
with n as (select o_custkey as cid, o_orderstatus as locale, min(o_orderkey)::varchar as name from orders group by all)
select cid, f.name as "name_F", o.name as "name_O", p.name as "name_P", coalesce(f.name, o.name, p.name) as display
from (select cid, name from n where locale = 'F') f full join (select cid, name from n where locale = 'O') o using (cid) full join (select cid, name from n where locale = 'P') p using (cid)
"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("card"), F.concat_ws("|", "p_name", "p_brand").alias("name"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as records: every fifth lacks the direct id and has the name of the part with twice its key."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("record"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).alias("direct"), (F.col("s_suppkey") * 2).alias("named"))
    names = cards(spark, d).withColumnRenamed("card", "named")
    return identity.place_records(own.join(names, "named", "left").select("record", "direct", F.coalesce("name", F.lit("")).alias("name")), cards(spark, d))


def identity_mapping(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d)


def identity_status(spark: SparkSession, d: str) -> DataFrame:
    return identity.support_status(cards(spark, d), placed(spark, d))


PLACED = """
c as (select p_partkey as card, p_name || '|' || p_brand as name from part), u as (select name, min(card) as name_card from c group by name having count(*) = 1),
r as (select s_suppkey as record, case when s_suppkey % 5 <> 0 then s_suppkey end as direct, coalesce(c.name, '') as name from supplier left join c on c.card = s_suppkey * 2),
placed as (select record, coalesce(c.card, case when direct is null then name_card end) as card, case when c.card is not null then 'direct' when direct is null and name_card is not null then 'name' else 'unplaced' end as method
  from r left join c on c.card = direct left join u on u.name = r.name)
"""


def identity_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return identity.duplicate_keys(cards(spark, d), ["name"])


def keys_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("cid")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cid"))


def unprinted(spark: SparkSession, d: str) -> DataFrame:
    listed, prints = keys_of(spark, d)
    return listed.join(prints, "cid", "left_anti")


def printed(spark: SparkSession, d: str) -> DataFrame:
    listed, prints = keys_of(spark, d)
    return listed.join(prints, "cid", "left_semi")


def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    return identity.coverage(*keys_of(spark, d), "cid")


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """(order, line) pairs of early and of late shipments, which should be equal sets and aren't."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cid"), F.col("l_linenumber").alias("rid"), "l_returnflag")
    return identity.set_difference(items.where("l_returnflag = 'R'").drop("l_returnflag"), items.where("l_returnflag = 'A'").drop("l_returnflag"), ("detail", "product"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Nations and thousands of account balances, of all customers and of all suppliers."""
    a, b = (table(spark, d, name).select(F.col(f"{x}_nationkey").alias("nation"), F.floor(F.col(f"{x}_acctbal") / 1000).alias("thousands")) for name, x in (("customer", "c"), ("supplier", "s")))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


RANKS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def lowest_rarity(spark: SparkSession, d: str) -> DataFrame:
    return identity.first_rank(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), RANKS)


def code_consistency(spark: SparkSession, d: str) -> DataFrame:
    return identity.inconsistent(table(spark, d, "lineitem"), ["l_partkey", "l_linenumber"], F.col("l_returnflag"))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return identity.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def page_total_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.sequence_audit(table(spark, d, "conversations"), "conv_id", "turn")


def record_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "flag": F.col("l_returnflag") != "N", "ship": F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")}
    return quality.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], rules).withColumn("problems", F.array_join("problems", ","))


def gated_publish(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    bad = quality.violations(items, ["l_orderkey"], {"quantity": F.col("l_quantity") <= 45})
    return quality.publishable(items, bad, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def status_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    state = history.outcome(F.col("event_type"))
    return rows.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ("stored", "failed", "empty", "pending")])


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.countDistinct("l_partkey").alias("kinds"), F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("pieces"))


def sampled_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return identity.audit_sample(rows, "o_orderstatus", "o_orderkey", 100, F.col("o_orderkey") < 10)


def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    joined = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("pages"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count_if(F.col("lines").isNull()).alias("without"))


QUERIES = {
    "locale_union": locale_union, "locale_union_pivot": locale_union_pivot, "identity_mapping": identity_mapping, "identity_status": identity_status, "identity_ambiguity": identity_ambiguity,
    "unprinted_orders": unprinted, "printed_semi": printed, "coverage_status": coverage_status, "set_equality_audit": set_equality, "set_ops_union_intersect_except": set_operations,
    "lowest_rarity": lowest_rarity, "code_consistency": code_consistency, "duplicate_keys": duplicates, "page_total_audit": page_total_audit, "record_rules": record_rules, "gated_publish": gated_publish,
    "status_counters": status_counters, "distinct_counts": distinct_counts, "sampled_audit": sampled_audit, "report_rollup": report_rollup,
}
SQL = {
    "locale_union": UNION,
    "locale_union_pivot": UNION,
    "identity_mapping": f"with {PLACED} select record, card, method from placed",
    "identity_status": f"""with {PLACED}, n as (select card, count(*) as records from placed where card is not null group by card), o as (select count(*) as open_end from placed where method = 'unplaced')
        select c.card, coalesce(records, 0) as records, case when records > 0 then 'supported' when open_end > 0 then 'unresolved' else 'unsupported' end as status from c cross join o left join n on n.card = c.card""",
    "identity_ambiguity": "select p_name || '|' || p_brand as name, count(*) as times from part group by 1 having count(*) > 1",
    "unprinted_orders": "select o_orderkey as cid from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "printed_semi": "select o_orderkey as cid from orders where o_orderkey in (select l_orderkey from lineitem)",
    "coverage_status": """select o_orderkey as cid, coalesce(n, 0) as prints, case when n is null then 'no_printing' else 'printed' end as coverage
        from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey""",
    "set_equality_audit": """with a as (select distinct l_orderkey as cid, l_linenumber as rid from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey as cid, l_linenumber as rid from lineitem where l_returnflag = 'A')
        select *, 'detail' as only_in from (select * from a except select * from b) union all select *, 'product' from (select * from b except select * from a)""",
    "set_ops_union_intersect_except": """with a as (select c_nationkey as nation, floor(c_acctbal / 1000)::bigint as thousands from customer), b as (select s_nationkey as nation, floor(s_acctbal / 1000)::bigint as thousands from supplier)
        select *, 'union' as kind from (select * from a union select * from b) union all select *, 'intersect' from (select * from a intersect select * from b)
        union all select *, 'except' from (select * from a except select * from b) union all select *, 'union_all' from (select * from a union all select * from b)""",
    "lowest_rarity": """select o_custkey, min(6 - substr(o_orderpriority, 1, 1)::int) as place, arg_min(o_orderpriority, 6 - substr(o_orderpriority, 1, 1)::int) as value from orders group by o_custkey""",
    "code_consistency": """select l_partkey, l_linenumber, string_agg(distinct l_returnflag, ',' order by l_returnflag) as seen, count(distinct l_returnflag) as n_values from lineitem group by all having count(distinct l_returnflag) > 1""",
    "duplicate_keys": "select l_orderkey, l_linenumber, count(*) as times from lineitem group by all having count(*) > 1",
    "page_total_audit": """select conv_id, count(*) as rows, count(distinct turn) as places, max(turn) as last, min(turn) as first,
        count(*) = max(turn) + 1 and count(distinct turn) = count(*) and min(turn) = 0 as complete from conversations group by conv_id""",
    "record_rules": """with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', case when l_quantity > 45 then 'quantity' end, case when l_discount >= 0.1 then 'discount' end,
        case when l_returnflag = 'N' then 'flag' end, case when l_shipdate >= '1998-06-01' then 'ship' end) as problems from lineitem) select * from v where problems <> ''""",
    "gated_publish": "select l_orderkey, count(*) as lines from lineitem group by l_orderkey having max(l_quantity) <= 45",
    "status_counters": """select user_id, count(*) as total, count(*) filter (event_type = 'purchase') as stored, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'signup') as empty,
        count(*) filter (event_type not in ('purchase', 'error', 'signup')) as pending from events group by user_id""",
    "distinct_counts": "select l_returnflag, l_linestatus, count(distinct l_partkey) as kinds, count(*) as lines, sum(l_quantity)::bigint as pieces from lineitem group by all",
    "sampled_audit": """select distinct o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by md5(o_orderkey || ':audit'), o_orderkey) as k from orders) where k <= 100 or o_orderkey < 10""",
    "report_rollup": """select o_orderstatus, min(o_orderdate) as first, max(o_orderdate) as last, count(*) as pages, coalesce(sum(n), 0)::bigint as lines, count(*) filter (n is null) as without
        from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by o_orderstatus""",
}

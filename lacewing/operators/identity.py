"""Catalogue identity: locale union, mapping of records to cards, coverage and consistency of prints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locale_union(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with a name for each locale, null where it isn't listed, and `display`, the first name in locale order."""
    parts = [df.select(key, F.col("name").alias(f"name_{locale}")) for locale, df in lists.items()]
    wide = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    return wide.withColumn("display", F.coalesce(*[F.when(F.col(f"name_{x}") != "", F.col(f"name_{x}")) for x in lists]))


def locale_pivot(rows: DataFrame, key: str, locale: str, locales: list[str]) -> DataFrame:
    """The same by one grouped aggregation of (key, locale, name); names of one key and locale give the least."""
    wide = rows.groupBy(key).agg(*[F.min(F.when(F.col(locale) == x, F.col("name"))).alias(f"name_{x}") for x in locales])
    return wide.withColumn("display", F.coalesce(*[F.when(F.col(f"name_{x}") != "", F.col(f"name_{x}")) for x in locales]))


def place_records(records: DataFrame, cards: DataFrame) -> DataFrame:
    """(record, card, method) of records (record, direct, name) on cards (card, name).

    The direct id places a record if the card exists; without one its name does, if exactly one card has it. All
    else is unplaced.
    """
    by_id = cards.select(F.col("card").alias("id_card"))
    only = cards.groupBy("name").agg(F.min("card").alias("name_card"), F.count("*").alias("same")).where("same = 1").drop("same")
    joined = records.join(by_id, records.direct == by_id.id_card, "left").join(only, "name", "left")
    named = F.col("direct").isNull() & F.col("name_card").isNotNull()
    method = F.when(F.col("id_card").isNotNull(), "direct").when(named, "name").otherwise("unplaced")
    return joined.select("record", F.coalesce("id_card", F.when(named, F.col("name_card"))).alias("card"), method.alias("method"))


def support_status(cards: DataFrame, placed: DataFrame) -> DataFrame:
    """supported, unsupported, or unresolved: one unplaced record anywhere means that no card's absence is certain."""
    open_end = placed.where("method = 'unplaced'").agg(F.count("*") > 0).scalar()
    own = placed.where("card is not null").groupBy("card").agg(F.count("*").alias("records"))
    status = F.when(F.col("records") > 0, "supported").when(open_end, "unresolved").otherwise("unsupported")
    return cards.select("card").join(own, "card", "left").select("card", F.coalesce("records", F.lit(0)).alias("records"), status.alias("status"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def coverage(listed: DataFrame, prints: DataFrame, key: str) -> DataFrame:
    """Of each listed key: how many prints it has, and `printed` or `no_printing`."""
    own = prints.groupBy(key).agg(F.count("*").alias("prints"))
    return listed.join(own, key, "left").select(key, F.coalesce("prints", F.lit(0)).alias("prints"), F.when(F.col("prints").isNull(), "no_printing").otherwise("printed").alias("coverage"))


def set_difference(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows that only one side has, tagged with its name; empty if the two sets are equal. Nulls are equal, as in EXCEPT. Both sides are one
    aggregation, whose map side drops repeats, and nothing is sorted."""
    both = left.withColumn("only_in", F.lit(names[0])).unionByName(right.withColumn("only_in", F.lit(names[1])))
    sides = both.groupBy(*left.columns).agg(F.count_if(F.col("only_in") == names[0]).alias("here"), F.count_if(F.col("only_in") == names[1]).alias("there"))
    return sides.where("here = 0 or there = 0").select(*left.columns, F.when(F.col("here") > 0, names[0]).otherwise(names[1]).alias("only_in"))


def inconsistent(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys with several values."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value.cast("string"))), ",").alias("seen"), F.countDistinct(value).alias("n_values")).where("n_values > 1")


def first_rank(rows: DataFrame, keys: list[str], value: Column, order: list[str]) -> DataFrame:
    """Of each key the value that stands first in `order`."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return rows.groupBy(*keys).agg(F.min(place).cast("int").alias("place")).withColumn("value", F.element_at(F.array(*map(F.lit, order)), F.col("place")))


def audit_sample(rows: DataFrame, stratum: str, key: str, size: int, always: Column, seed: str = "audit") -> DataFrame:
    """`size` rows of each stratum in the order of a hash, and those always wanted. The same rows each time."""
    from pyspark.sql import Window

    ticket = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(ticket, key)))
    return ranked.where(F.col("place") <= size).drop("place").unionByName(rows.where(always)).distinct()


def records_of_ids(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, record, records, finding) of each of `labels` (label) on `records` (record, ids): the record one of whose ids it is, and how many
    have it. A label that no record has is `unplaced`, one of several `ambiguous`, and neither has a record."""
    each = records.select("record", F.explode(F.array_distinct("ids")).alias("label"))
    held = each.groupBy("label").agg(F.min("record").alias("one"), F.countDistinct("record").alias("records"))
    n = F.coalesce("records", F.lit(0))
    finding = F.when(n == 0, "unplaced").when(n > 1, "ambiguous")
    return labels.select("label").join(held, "label", "left").select("label", F.when(n == 1, F.col("one")).alias("record"), n.alias("records"), finding.alias("finding"))


def outside(placed: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys that something is placed on and no list has."""
    return placed.where(F.col(key).isNotNull()).select(key).distinct().join(listed.select(key), key, "left_anti")


def coverage_audit(claims: DataFrame, prints: DataFrame, listed: DataFrame, key: str, locale: str) -> DataFrame:
    """(key, locale, finding) where claims (key, locale, coverage), prints and lists don't agree, seen from each of the three: `not covered` (listed,
    no claim), `not listed` (a claim or a print without a listing), `no prints` (claimed as printed) and `has prints` (claimed as not)."""
    on = [key, locale]
    a, b, c = (df.select(*on).distinct().withColumn(n, F.lit(True)) for df, n in ((claims, "claimed"), (prints, "printed"), (listed, "listed")))
    every = a.join(b, on, "full").join(c, on, "full").join(claims.select(*on, "coverage"), on, "left")
    no = lambda n: F.col(n).isNull()
    finding = F.when(no("listed"), "not listed").when(no("claimed"), "not covered").when((F.col("coverage") == "printed") & no("printed"), "no prints").when((F.col("coverage") != "printed") & ~no("printed"), "has prints")
    return every.select(*on, finding.alias("finding")).where("finding is not null")

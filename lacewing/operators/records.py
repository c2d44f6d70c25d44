"""Cached envelopes, price records, and lists held against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import problems

STOCK = ("in_stock", "out_of_stock", "unknown")


def envelope_problems(envelopes: DataFrame, products: DataFrame, key: str, lifetime: str) -> DataFrame:
    """(key, problems) of unsound envelopes (key, format, scope, expires_at) with products (key, product_id, name, price, stock, url, prefix,
    observed_at): none at all, a repeated or malformed id, a field out of its domain, or an expiry that isn't the first observation's.

    One grouped aggregation; an envelope's ids are only counted, so its size doesn't matter.
    """
    sound = {
        "name": F.col("name") != "", "price": F.col("price") > 0, "stock": F.col("stock").isin(*STOCK),
        "url": F.col("url") == F.concat(F.col("prefix"), F.col("product_id")), "product_id": F.col("product_id").rlike("^[0-9]+$"),
    }
    checks = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"bad_{name}") for name, rule in sound.items()]
    per = products.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("ids"), F.min("observed_at").alias("first"), *checks)
    rules = {"products": F.col("n") > 0, "unique": F.col("ids") == F.col("n")} | {name: F.col(f"bad_{name}") == 0 for name in sound}
    rules["expiry"] = F.col("expires_at") == F.col("first") + F.expr(lifetime)
    found = envelopes.join(per, key, "left").select(key, F.when(F.col("n").isNull(), F.array(F.lit("products"))).otherwise(problems(rules)).alias("problems"))
    return found.where(F.size("problems") > 0)


def price_problem(status: Column, unit: Column, observed: Column, priced: tuple[str, ...]) -> Column:
    """What is wrong with a price record: a priced status needs a positive unit price and a time, any other must have no price."""
    has = status.isin(*priced)
    return F.when(status.isNull(), "status").when(has & ~F.coalesce(unit > 0, F.lit(False)), "unit").when(has & observed.isNull(), "time").when(~has & unit.isNotNull(), "unpriced")


def lookup_status(number: Column, locale: Column, regions: dict[str, str], pattern: str, listed: Column) -> Column:
    """Why a print can't be looked up, before any listing is read: not listed, without number, or a number of another edition; else null."""
    region = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])[F.regexp_extract(number, pattern, 1)]
    whole = F.when(number.rlike(pattern), region)
    return F.when(~listed, "not_listed").when(F.coalesce(number, F.lit("")) == "", "no_card_number").when(whole.isNull() | (whole != locale), "no_edition_print")


def error_status(kind: Column, table: dict[str, str], other: str) -> Column:
    """The status that a class of errors leads to."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind], F.lit(other))


def list_audit(rows: DataFrame, known: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known at all (`unknown`) or known but not on the list (`unlisted`)."""
    a, b = known.select(key).distinct().withColumn("is_known", F.lit(True)), listed.select(key).distinct().withColumn("is_listed", F.lit(True))
    finding = F.when(F.col("is_known").isNull(), "unknown").when(F.col("is_listed").isNull(), "unlisted")
    return rows.join(a, key, "left").join(b, key, "left").withColumn("finding", finding).drop("is_known", "is_listed").where("finding is not null")


def code_audit(rows: DataFrame, dictionary: DataFrame, code: str, label: str) -> DataFrame:
    """Rows whose code the dictionary (code, label) lacks, or labels otherwise. The dictionary is a small fixed table."""
    expected = dictionary.select(code, F.col(label).alias("expected"))
    finding = F.when(F.col("expected").isNull(), "missing").when(F.col("expected") != F.col(label), "label")
    return rows.join(expected, code, "left").withColumn("finding", finding).where("finding is not null")


def unexplained(names: DataFrame, labels: DataFrame, explained: DataFrame, name: str, key: str) -> DataFrame:
    """Names that some label has and that no record of another key explains."""
    other = explained.select(F.col(name).alias("o_name"), F.col(key).alias("o_key"))
    return names.join(labels.select(name), name, "left_semi").join(other, (F.col(name) == F.col("o_name")) & (F.col(key) != F.col("o_key")), "left_anti")


def first_locale(rows: DataFrame, keys: list[str], locale: Column, order: tuple[str, ...], sequence: list[str]) -> DataFrame:
    """One row a key: of the first locale in `order` that has it."""
    rank = F.array_position(F.array(*map(F.lit, order)), locale)
    rest = [c for c in rows.columns if c not in keys]
    return rows.where(rank > 0).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, *sequence)).alias("r")).select(*keys, "r.*")


def artworks(rows: DataFrame, keys: list[str], locale: Column, digest: str, placeholder: Column, order: tuple[str, ...]) -> DataFrame:
    """One row a key (a card and its artwork): the locale and digest of the first in `order` that has more than a placeholder, the locales
    before it that had one, in order, and whether none has more. Of several rows of a locale the least digest counts."""
    rank = F.array_position(F.array(*map(F.lit, order)), locale)
    each = rows.select(*keys, rank.alias("rank"), digest, F.coalesce(placeholder, F.lit(False)).alias("empty")).where("rank > 0")
    found = each.groupBy(*keys).agg(F.min(F.when(~F.col("empty"), F.struct("rank", digest))).alias("first"), F.collect_set(F.when(F.col("empty"), F.col("rank"))).alias("tried"))
    name = lambda r: F.element_at(F.array(*map(F.lit, order)), r.cast("int"))
    before = F.filter(F.array_sort("tried"), lambda r: F.col("first").isNull() | (r < F.col("first.rank")))
    return found.select(*keys, F.when(F.col("first").isNotNull(), name(F.col("first.rank"))).alias("locale"), F.col(f"first.{digest}").alias(digest), F.array_join(F.transform(before, name), ",").alias("placeholders"), F.col("first").isNull().alias("unavailable"))


def best_evidence(rows: DataFrame, key: str, score: str, sequence: str) -> DataFrame:
    """Each key's row with the highest score, the earliest of equals."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(sequence))).alias("b")).select(key, "b.*")


def page_rules(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Per page of each group's (group, page, item, total): the rows that the total asks for, found rows, repeats, and whether the
    reported total drifts or doesn't match the group's rows."""
    whole = rows.groupBy(group).agg(F.count("*").alias("rows"), F.min("total").alias("least"), F.max("total").alias("most"))
    per = rows.groupBy(group, "page").agg(F.count("*").alias("found"), F.countDistinct("item").alias("items"))
    asked = F.greatest(F.least(F.lit(size), F.col("most") - (F.col("page") - 1) * size), F.lit(0))
    return per.join(whole, group).select(
        group, "page", F.ceil(F.col("most") / size).alias("pages"), asked.alias("asked"), "found", (F.col("found") - F.col("items")).alias("repeats"),
        (F.col("least") != F.col("most")).alias("drift"), (F.col("rows") == F.col("most")).alias("complete"),
    )

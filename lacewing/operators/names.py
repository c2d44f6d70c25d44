"""Names to official cards: exact search over result pages, a cache beside it, and the guards in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results on a page, the longest name that is looked up, and the locales.
PER_PAGE, LONGEST, LOCALES = 100, 200, ("ja", "en", "ko")
#: Official names under the keys that labels use, and keys that are searched under another keyword.
ALIASES = {
    "spell reactor ・re": "spell reactor re",
    "trap reactor ・y fi": "trap reactor y fi",
    "summon reactor ・sk": "summon reactor sk",
    "invoked baybarron": "invoked babalon",
    "the fallen & the virtuous": "the fallen &amp; the virtuous",
}
KEYWORDS = {
    "invoked babalon": "Invoked Baybarron",
    "the fallen &amp; the virtuous": "The Fallen & The Virtuous",
}


def checked(locale: str, rarities: list[str], known: tuple[str, ...], cids: list[int]) -> None:
    """Arguments of a lookup, judged before any plan is made."""
    if locale not in LOCALES:
        raise ValueError(f"no such locale: {locale!r}")
    if unknown := sorted(set(rarities) - set(known)):
        raise ValueError(f"no such rarities: {unknown}")
    if wrong := [c for c in cids if isinstance(c, bool) or not isinstance(c, int) or c <= 0]:
        raise ValueError(f"no card ids: {wrong}")


def keyword(key: Column, name: Column, keywords: dict[str, str] = KEYWORDS) -> Column:
    """What to search for a name of that key."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in keywords.items() for x in pair]), key), name)


def exact_ids(pages: DataFrame, wanted: str, key: Column, per_page: int = PER_PAGE) -> DataFrame:
    """(wanted, cid, found, problem) of each name searched for: the one card whose name has its key.

    `pages` has `wanted`, page (from 1), total, cards (name, cid) and problem of each result page; `key` is the key of a card's name, in
    terms of c. As many pages count as the first one's total asks for, and all of them must be there and sound; then no
    such card is `unknown`, and several are `ambiguous`. Nothing is taken from a search with a problem.
    """
    first = pages.groupBy(wanted).agg(F.max(F.when(F.col("page") == 1, F.col("total"))).alias("all"))
    counted = pages.join(first, wanted).where((F.col("page") == 1) | ((F.col("page") - 1) * per_page < F.col("all")))
    whole = counted.groupBy(wanted).agg(F.countDistinct("page").alias("pages"), F.max("all").alias("all"), F.min("problem").alias("fault"))
    hits = counted.select(wanted, F.explode("cards").alias("c")).where(key == F.col(wanted)).groupBy(wanted).agg(F.countDistinct("c.cid").alias("found"), F.min("c.cid").alias("cid"))
    found = F.coalesce("found", F.lit(0))
    problem = F.coalesce("fault", F.when(F.col("all").isNull() | (F.col("pages") < F.greatest(F.ceil(F.col("all") / per_page), F.lit(1))), "missing page").when(found == 0, "unknown").when(found > 1, "ambiguous"))
    return whole.join(hits, wanted, "left").select(wanted, F.when(problem.isNull(), F.col("cid")).alias("cid"), found.alias("found"), problem.alias("problem"))


def resolved(wanted: DataFrame, cached: DataFrame, searched: DataFrame, details: DataFrame) -> DataFrame:
    """(key, cid, source, problem, keep) of each key of `wanted`: from `cached` (key, cid, problem) if it has the key, sound or not; else from the
    search (key, cid, problem) and the detail page (cid, key, problem) of the card found.

    A cached entry with a problem is an error and is not searched anew. What is found is kept for the cache only if search and detail
    page are sound and the page's name has the key; a failure never is. A key without a search yet is `to search`.
    """
    hit = cached.select("key", F.col("cid").alias("c_cid"), F.col("problem").alias("c_problem"), F.lit(True).alias("hit"))
    search = searched.select("key", F.col("cid").alias("s_cid"), F.col("problem").alias("s_problem"), F.lit(True).alias("asked"))
    page = details.select(F.col("cid").alias("s_cid"), F.col("key").alias("d_key"), F.col("problem").alias("d_problem"), F.lit(True).alias("seen"))
    rows = wanted.select("key").distinct().join(hit, "key", "left").join(search, "key", "left").join(page, "s_cid", "left")
    late = F.when(F.col("asked").isNull(), "to search").when(F.col("s_problem").isNotNull(), F.col("s_problem")).when(F.col("seen").isNull(), "no detail page").when(F.col("d_problem").isNotNull(), F.col("d_problem")).when(F.coalesce(F.col("d_key") != F.col("key"), F.lit(True)), "other name")
    problem = F.when(F.col("hit"), F.col("c_problem")).otherwise(late)
    source = F.when(F.col("hit"), "cache").when(F.col("asked"), "search")
    return rows.select("key", F.when(problem.isNull(), F.when(F.col("hit"), F.col("c_cid")).otherwise(F.col("s_cid"))).alias("cid"), source.alias("source"), problem.alias("problem"), (problem.isNull() & F.col("hit").isNull()).alias("keep"))


def labelled(candidates: DataFrame, labels: DataFrame, index: str) -> DataFrame:
    """`candidates` with the columns of `labels` for their `index`; one that no label has ends the job."""
    held = candidates.join(labels.withColumn("_known", F.lit(True)), index, "left")
    missing = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no label "), F.coalesce(F.col(index).cast("string"), F.lit("null")))).cast("boolean"))
    return held.where(F.coalesce(missing, F.lit(True))).drop("_known")


def queryable_numbers(prints: DataFrame, keys: list[str], number: str, rid: str, chosen: list[int], queryable: Column) -> DataFrame:
    """(keys, numbers): of each key the numbers of the chosen rarities that can be looked up, once each and in order."""
    return prints.where(F.col(rid).isin(chosen) & queryable).groupBy(*keys).agg(F.array_sort(F.collect_set(number)).alias("numbers"))

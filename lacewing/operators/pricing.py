"""Price selection: official prints, observed listings and the label map give each print's status and price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which rids a shop's label may mean.
FAMILIES = {"1-URGENT": [1], "2-HIGH": [2], "3-MEDIUM": [3, 4], "4-NOT SPECIFIED": [], "5-LOW": [5, 6, 7]}
#: All rids that a label may mean; one's place is its bit.
RIDS = sorted({r for rids in FAMILIES.values() for r in rids})
PRICED = ("ok", "out_of_stock", "stock_unknown")
BY_STOCK = {"in_stock": "ok", "out_of_stock": "out_of_stock"}


def family(label: Column) -> Column:
    """The rids of a label; none for an unknown one."""
    out = None
    for name, rids in FAMILIES.items():
        ids = F.array(*[F.lit(r) for r in rids]).cast("array<int>")
        out = F.when(label == name, ids) if out is None else out.when(label == name, ids)
    return out.otherwise(F.array().cast("array<int>"))


def rid_bit(rid: Column) -> Column:
    """The bit of a rid; 0 for one that no label means."""
    out = F.when(rid == RIDS[0], 1)
    for i, r in enumerate(RIDS[1:], 1):
        out = out.when(rid == r, 1 << i)
    return out.otherwise(0).cast("long")


def family_bits(label: Column) -> Column:
    """The bits of a label's rids."""
    out = F.when(F.lit(False), 0)
    for name, rids in FAMILIES.items():
        out = out.when(label == name, sum(1 << RIDS.index(r) for r in rids))
    return out.otherwise(0).cast("long")


def only_rid(bits: Column) -> Column:
    """The rid of the only bit; null if there are none or several."""
    out = F.when(bits == 1, RIDS[0])
    for i, r in enumerate(RIDS[1:], 1):
        out = out.when(bits == 1 << i, r)
    return out


def mapped_rid(label_rids: Column, printed: Column) -> Column:
    """The one rid that the label may mean and that is printed at the number; null if none or several are."""
    both = F.array_intersect(label_rids, printed)
    return F.when(F.size(both) == 1, F.element_at(both, 1))


def select_prices(prints: DataFrame, listings: DataFrame, as_of: Column, lifetime: str) -> DataFrame:
    """Per (part, edition, rid) of `prints` (with number): status, price, counts and expiry.

    A listing's pool is its number; each rid that the number prints sees all of the pool. One future or
    expired observation in any of a rid's numbers decides the result, before any price. Then matched listings give the
    lowest price in stock, or else the lowest; then unverified ones, whose label maps to no single print, are named.
    All joins and groups are on the part, so its rows are shuffled once and stay where they are.
    """
    own = prints.distinct()
    printed = own.groupBy("part", "edition", "number").agg(F.collect_set("rid").alias("printed"))
    pool = listings.join(printed, ["part", "edition", "number"])
    pool = pool.select("part", "edition", "number", "product", "price", "stock", "observed", mapped_rid(family(F.col("label")), F.col("printed")).alias("mapped"))
    seen = own.join(pool, ["part", "edition", "number"], "left")
    hit, inside = F.col("mapped") == F.col("rid"), F.col("stock") == "in_stock"
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("p"), "price", "number", "product", "stock")
    per = seen.groupBy("part", "edition", "rid").agg(
        F.coalesce(F.max(F.col("observed") > as_of), F.lit(False)).alias("future"),
        F.coalesce(F.max(F.col("observed") + F.expr(lifetime) <= as_of), F.lit(False)).alias("stale"),
        F.count_if(hit).alias("matched"), F.count_if(hit & inside).alias("in_stock"), F.count_if(F.col("product").isNotNull() & F.col("mapped").isNull()).alias("unverified"),
        F.min(F.when(hit, rank)).alias("best"), (F.min("observed") + F.expr(lifetime)).alias("expires"),
    )
    stock = F.when(F.col("best.stock") == "in_stock", "ok").when(F.col("best.stock") == "out_of_stock", "out_of_stock").otherwise("stock_unknown")
    status = F.when(F.col("future"), "data_error").when(F.col("stale"), "expired").when(F.col("matched") > 0, stock).when(F.col("unverified") > 0, "unverified").otherwise("not_observed")
    return per.withColumn("status", status).select("part", "edition", "rid", "status", F.when(F.col("status").isin(*PRICED), F.col("best.price")).alias("price"), "matched", "in_stock", "unverified", "expires")

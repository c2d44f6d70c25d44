"""A digest of a table that no order or partitioning changes, and a tree of digests that tells where two tables differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a number that is summed, and of the longest prefix of a key's hash.
DIGITS, DEPTH = 15, 3


def canonical(*columns: Column) -> Column:
    """Values so written that different rows read differently: bytes, a colon and the value, or `-` for null. Columns are taken in the
    order given; name them in a fixed one."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns])


def row_numbers(*columns: Column) -> tuple[Column, Column]:
    """Two numbers below 2^60 of a row's digest."""
    digest = F.sha2(canonical(*columns), 256)
    return tuple(F.conv(F.substring(digest, 1 + DIGITS * k, DIGITS), 16, 10).cast("bigint") for k in (0, 1))


def leaves(rows: DataFrame, key: list[str], depth: int = DEPTH) -> DataFrame:
    """(prefix, rows, a, b): the digest of the rows whose key's hash begins with `prefix`. Sums of decimals, so that partial digests of any
    parts of a table add up to that of the whole; rows that repeat count each time."""
    rest = sorted(c for c in rows.columns if c not in key)
    a, b = row_numbers(*[F.col(c) for c in [*key, *rest]])
    prefix = F.substring(F.md5(canonical(*[F.col(k) for k in key]).cast("binary")), 1, depth)
    return rows.select(prefix.alias("prefix"), a.cast("decimal(20)").alias("a"), b.cast("decimal(20)").alias("b")).groupBy("prefix").agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def merged(parts: DataFrame, digits: int) -> DataFrame:
    """The digests of a level further up, or of several tables' leaves together."""
    return parts.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def fingerprint(parts: DataFrame) -> str:
    """One digest of the whole."""
    r = parts.agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return f"{r.rows or 0}:{r.a or 0}:{r.b or 0}"


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """The prefixes at which two tables' leaves differ: as many rows as prefixes at most, whatever the tables' sizes."""
    n = new.select("prefix", F.struct("rows", "a", "b").alias("new"))
    return old.select("prefix", F.struct("rows", "a", "b").alias("old")).join(n, "prefix", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("prefix")


def changes(old: DataFrame, new: DataFrame, key: list[str], depth: int = DEPTH) -> DataFrame:
    """(key, change): keys that were `added`, `removed` or `changed`. Only rows under a differing prefix are compared, so what is
    shuffled is what may have changed. A key with several rows is compared by the digests of all of them."""
    where = differing(leaves(old, key, depth), leaves(new, key, depth))
    prefix = F.substring(F.md5(canonical(*[F.col(k) for k in key]).cast("binary")), 1, depth)

    def sums(rows: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in rows.columns if c not in key)
        a, b = row_numbers(*[F.col(c) for c in [*key, *rest]])
        some = rows.withColumn("prefix", prefix).join(F.broadcast(where), "prefix", "left_semi")  # 16^depth rows at most
        each = some.select(*[F.col(k).alias(f"{name}_{k}") for k in key], a.cast("decimal(20)").alias("a"), b.cast("decimal(20)").alias("b"))
        return each.groupBy(*[f"{name}_{k}" for k in key]).agg(F.struct(F.count("*"), F.sum("a"), F.sum("b")).alias(name))

    o, n = sums(old, "old"), sums(new, "new")
    on = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in key]
    both = o.join(n, on, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in key], F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))

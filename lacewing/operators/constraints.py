"""Constraints on a batch before it is appended: unique keys, references and checks, against what is stored."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import stored

#: Rows of keys of a batch that may be broadcast to the stored table; a larger batch is shuffled with it.
BROADCAST_KEYS = 500_000


@dataclass
class Constraints:
    """unique: lists of columns; foreign: name -> (columns, referenced table, its columns); checks: name -> rule, broken when false
    (null passes, as in SQL)."""

    unique: list[list[str]] = field(default_factory=list)
    foreign: dict[str, tuple[list[str], DataFrame, list[str]]] = field(default_factory=dict)
    checks: dict[str, Column] = field(default_factory=dict)


def _keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each key stands; keys with a null are no keys, as in SQL."""
    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return rows.where(whole).groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("rows"))


def _shown(n: int) -> Column:
    return F.concat_ws(",", *[F.col(f"k{i}").cast("string") for i in range(n)]).alias("key")


def violations(batch: DataFrame, before: DataFrame, constraints: Constraints) -> DataFrame:
    """(constraint, key, rows): what an append of `batch` to `before` would break, and how many rows of the batch do it.

    The stored table is read once a unique key and once a reference, with only the key's columns, and meets the batch's keys where it lies
    as long as those can be broadcast; it isn't shuffled for its own sake. Repeats within `before` alone aren't looked for.
    """
    out = []
    for columns in constraints.unique:
        n, keys = len(columns), stored(_keys(batch, columns), "keys")
        small = F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
        held = before.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]).join(small.drop("rows"), [f"k{i}" for i in range(n)], "left_semi").distinct().withColumn("held", F.lit(True))
        found = keys.join(held, [f"k{i}" for i in range(n)], "left").where("held or rows > 1")
        out.append(found.select(F.lit(f"unique {', '.join(columns)}").alias("constraint"), _shown(n), "rows"))
    for name, (columns, table, referenced) in constraints.foreign.items():
        n, keys = len(columns), stored(_keys(batch, columns), "references")
        small = F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
        held = table.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(referenced)]).join(small.drop("rows"), [f"k{i}" for i in range(n)], "left_semi").distinct()
        out.append(keys.join(held, [f"k{i}" for i in range(n)], "left_anti").select(F.lit(f"reference {name}").alias("constraint"), _shown(n), "rows"))
    for name, rule in constraints.checks.items():
        broken = batch.where(~rule).agg(F.count("*").alias("rows")).where("rows > 0")
        out.append(broken.select(F.lit(f"check {name}").alias("constraint"), F.lit(None).cast("string").alias("key"), "rows"))
    return functools.reduce(DataFrame.unionByName, out)


def audited(rows: DataFrame, digest: str, sizes: dict[str, int], key: list[str]) -> DataFrame:
    """`rows` of a dump if it is the audited one; else an error. `digest` is the sum of its rows' digests (`digests.fingerprint`), and
    `sizes` the exact numbers of rows ("rows") and of different values by column."""
    from .digests import fingerprint, leaves

    found = rows.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(c) for c in sizes if c != "rows"]).first().asDict()
    wrong = [f"{name}: {found[name]}, not {n}" for name, n in sizes.items() if found[name] != n]
    if fingerprint(leaves(rows, key)) != digest:
        wrong.append("another digest")
    if wrong:
        raise ValueError(f"not the audited dump: {'; '.join(wrong)}")
    return rows

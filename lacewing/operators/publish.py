"""Sinks: staged publication behind a pointer, idempotent appends, spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import neutralized
from .history import append_new
from .ledger import Change, Ledger, Refused, Version


def publish(tables: dict[str, DataFrame], audits: dict[str, DataFrame], folder: str) -> int:
    """Puts all tables in the place of those before, as one version, and gives its number; readers see all of the old version or all
    of the new. An audit with any row stops it, and what was published stays. Of two at once both become versions, one after the other."""
    failed = [name for name, df in audits.items() if not df.isEmpty()]
    if failed:
        raise ValueError(f"not published: {', '.join(sorted(failed))}")
    made, _ = Ledger(next(iter(tables.values())).sparkSession, folder).commit(lambda seen: Change(replaced=tables))
    return made.number


def published(spark: SparkSession, folder: str) -> Version:
    """The last version. Tables that belong together are read with one such version."""
    return Ledger(spark, folder).head()


def current(spark: SparkSession, folder: str, name: str, version: Version | None = None) -> DataFrame:
    return Ledger(spark, folder).read(name, version or published(spark, folder))


def append_snapshots(batch: DataFrame, folder: str, keys: list[str], digest: str) -> dict[str, int]:
    """Appends the new rows of a batch and gives the counts. A key that stands twice in the batch goes in once; a key with another
    digest, stored or in the batch, is an error and nothing is appended. Two writers at once append a key once."""
    spark = batch.sparkSession
    ledger = Ledger(spark, folder, {"rows": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)})
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.min(F.struct(digest, *[c for c in rest if c != digest])).alias("row"), F.max(digest).alias("other"))

    def change(seen: Version) -> Change:
        tagged = append_new(one.select(*keys, "row.*", "other"), ledger.read("rows", seen), keys, digest)
        tagged = tagged.withColumn("action", F.when(F.col("other") != F.col(digest), "conflict").otherwise(F.col("action")))
        counts = {r.action: r["count"] for r in tagged.groupBy("action").count().collect()}
        if counts.get("conflict"):
            raise Refused(f"{counts['conflict']} keys have another digest")
        rows = {"rows": tagged.where("action = 'new'").select(*batch.columns)} if counts.get("new") else {}
        return Change(rows, result={"inserted": counts.get("new", 0), "unchanged": counts.get("unchanged", 0)})

    return ledger.commit(change)[1]


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header and a byte order mark in each part, empty text for null, and no cell that a spreadsheet would run."""
    names = [(c, t) for c, t in rows.dtypes]
    cells = [neutralized(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in names]
    safe = rows.select(*cells)
    first = "﻿" + names[0][0]
    safe.withColumnRenamed(names[0][0], first).write.option("header", True).option("encoding", "UTF-8").option("emptyValue", "").option("nullValue", "").csv(folder)

"""Numbers for rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: what comes after it never runs it anew."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with `rank`, from 0 in `order`, which must tell all rows apart. Rows are range-sorted; one row a partition says how many
    came before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")

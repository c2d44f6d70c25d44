"""Parquet tables by name, with only what the plans read left in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """The rows dealt by key to all cores: rows of few bytes may become long work, which files and adaptive partitions of a few tasks would
    leave to some of them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *key)


#: Rows of a part, where a task sorts or groups all of its part.
PART_ROWS = 500_000


def spread(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The rows dealt by key to as many parts as `rows` of them ask for, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *key)


def elements(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """A row for each element of an array of structs. A plain `explode` also filters by the array's size below all that makes it, and so has
    it made twice, with the pages read for it."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def moment(value: object) -> Column:
    """A fixed time without zone. `as_of` is always an argument of the operators, so a rerun gives what the run gave."""
    return F.lit(str(value)).cast("timestamp_ntz")


def latest(df: DataFrame, column: str) -> object:
    return df.agg(F.max(column)).first()[0]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share. Only a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm import decontamination, lines, mixing, simhash, toxicity
from lacewing.llm.common import WORD, named, spare, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labels of `docs`, doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; one that loses all it had goes. n_chars follows the text."""
    counters = spare(docs, "n_lines"), spare(docs, "n_removed")
    changed = F.col(counters[1]) > 0
    left = lines.dedup_lines(docs, counters=counters).where(~changed | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*map(named, docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's rate and its draw give, numbered in `copy`."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("benchmark_decontamination", decontaminate), ("mixing", mix_sources)]
#: The classifier and the hashes of the near-duplicate stages have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

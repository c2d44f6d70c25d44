"""Rules over records: violations, and a gate that publishes only what has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PROBLEMS = 5


def problems(rules: dict[str, Column], most: int = MOST_PROBLEMS) -> Column:
    """The names of the rules that a row breaks, the first few. A rule that gives null is broken."""
    named = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.slice(F.array_compact(F.array(*named)), 1, most)


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    return rows.select(*key, problems(rules).alias("problems")).where(F.size("problems") > 0)


def publishable(rows: DataFrame, violations: DataFrame, group: list[str]) -> DataFrame:
    """The rows of groups without any violation: one bad member holds back all of its group."""
    return rows.join(violations.select(*group).distinct(), group, "left_anti")


def sequence_audit(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Keys whose places aren't 0, 1, 2, … each once."""
    per = rows.groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct(place).alias("places"), F.max(place).alias("last"), F.min(place).alias("first"))
    return per.withColumn("complete", (F.col("rows") == F.col("last") + 1) & (F.col("places") == F.col("rows")) & (F.col("first") == 0))

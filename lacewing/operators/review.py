"""Candidates of a photo: which evidence is enough, and in what order they are shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a match needs to be accepted, and how many candidates are shown.
INLIERS, RATIO, SPREAD, MARGIN, SHOWN = 12, 0.25, 0.15, 2.0, 3


def decisions(evidence: DataFrame, photo: list[str], inliers: int = INLIERS) -> DataFrame:
    """Per photo of (cid, inliers, ratio, spread, geometry_problem): the leading cid, its margin over the second, and whether it is accepted."""
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy(*photo).orderBy(F.desc("inliers"), "cid"))).where("rank <= 2")
    own = [F.max(F.when(F.col("rank") == 1, F.struct("cid", "inliers", "ratio", "spread", "geometry_problem"))).alias("best")]
    top = ranked.groupBy(*photo).agg(*own, F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("inliers"))), F.lit(0)).alias("second"))
    margin, best = F.col("best.inliers") / F.greatest("second", F.lit(1)), F.col("best")
    accepted = best["geometry_problem"].isNull() & (best["inliers"] >= inliers) & (best["ratio"] >= RATIO) & (best["spread"] >= SPREAD) & (margin >= MARGIN)
    return top.select(*photo, best["cid"].alias("cid"), (F.rint(margin * 100) / 100).alias("margin"), accepted.alias("accepted"))


def with_evidence(candidates: Column, evidence: Column) -> Column:
    """Each candidate (cid, …) with the inliers of the evidence map (cid -> inliers), 0 without any."""
    return F.transform(candidates, lambda c: F.struct(c["cid"].alias("cid"), c["name"].alias("name"), F.coalesce(F.try_element_at(evidence, c["cid"]), F.lit(0).cast("bigint")).alias("inliers")))


def winner_first(candidates: Column, won: Callable[[Column], Column]) -> Column:
    """The candidates that won in front, all else in its order."""
    return F.concat(F.filter(candidates, won), F.filter(candidates, lambda c: ~F.coalesce(won(c), F.lit(False))))


def reference_first(reference: Column, candidates: Column, shown: int = SHOWN) -> Column:
    """The reference's candidate, then those of another name, at most `shown`."""
    return F.slice(F.concat(F.array(reference), F.filter(candidates, lambda c: ~F.coalesce(F.lower(c["name"]) == F.lower(reference["name"]), F.lit(False)))), 1, shown)

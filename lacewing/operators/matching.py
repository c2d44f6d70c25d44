"""Decisions over nearest neighbours: votes, margins, mutual matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def ratio_votes(near: DataFrame, ratio: float) -> DataFrame:
    """Queries whose nearest vector is nearer than `ratio` times the nearest of another label vote for its label. `near` has the nearest of
    each query and label, of the two nearest labels at least."""
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "label")))
    best = ranked.groupBy("query").agg(F.min(F.when(F.col("place") == 1, F.col("label"))).alias("label"), F.min(F.when(F.col("place") == 1, F.col("distance"))).alias("first"), F.min(F.when(F.col("place") == 2, F.col("distance"))).alias("second"))
    return best.withColumn("distinctive", F.coalesce(F.col("first") < ratio * F.col("second"), F.lit(False)))


def shared_votes(near: DataFrame, vectors: DataFrame, ratio: float) -> DataFrame:
    """A query's vote is split over the labels of the neighbours about as near as the first, and a label's votes over its vectors."""
    first = near.groupBy("query").agg(F.min("distance").alias("first"))
    contenders = near.join(first, "query").where(ratio * F.col("distance") <= F.col("first")).select("query", "label").distinct()
    share = contenders.groupBy("query").agg((1.0 / F.count("*")).alias("share"))
    size = vectors.groupBy("label").agg(F.count("*").alias("size"))
    votes = contenders.join(share, "query").groupBy("label").agg(F.sum("share").alias("votes"))
    return votes.join(size, "label").select("label", F.round("votes", 6).alias("votes"), F.round(F.col("votes") / F.col("size"), 8).alias("weighed"))


def margins(near: DataFrame, least: float) -> DataFrame:
    """Votes of each query's neighbours by label: the first, how far ahead of the second, and whether that is enough."""
    votes = near.groupBy("query", "query_label", "label").agg(F.count("*").alias("n"))
    ranked = votes.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "label")))
    top = ranked.groupBy("query", "query_label").agg(F.max(F.when(F.col("place") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("place") == 1, F.col("n"))).alias("votes"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("next"))
    margin = F.col("votes") / F.greatest("next", F.lit(1))
    return top.withColumn("margin", margin).withColumn("accepted", margin >= least)


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    a = forward.where("place = 1").select(F.col("query").alias("a"), F.col("vec_id").alias("b"), "distance")
    b = backward.where("place = 1").select(F.col("vec_id").alias("a"), F.col("query").alias("b"))
    return a.join(b, ["a", "b"])

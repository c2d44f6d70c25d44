"""Suppression of overlapping intervals and boxes in score order, in rounds over grid cells.

What is kept one after another in score order is also found in rounds: an item that no better undecided item can overlap is kept,
and what it overlaps too much goes. Items that can overlap share a cell, so a round needs the best item of each cell and never
pairs all items of a cell with each other; a group of any size is spread over its cells. Groups of a few items, which would be mostly
cells of their own, are shuffled once and compared in pairs instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import stored

#: The finest and the coarsest cells are of 2 to the power of these, in units of the coordinates, which lie below the coarsest.
FINEST, COARSEST = -20, 40
#: Items of a group whose pairs are compared as they are; a larger group goes by cells.
FEW = 32
Overlap = Callable[[DataFrame], DataFrame]


def _cells(items: DataFrame, axes: list[tuple[str, str]], reach: int, finest: int, coarsest: int) -> DataFrame:
    """A row for each cell that an item covers: at its own level, whose cells are at least as wide as it is, and at `reach` coarser
    ones, where only the items that are of that level stand against it. An item covers two cells an axis at most."""
    width = F.greatest(*[F.col(hi) - F.col(lo) for lo, hi in axes], F.lit(2.0**finest))
    rows = items.withColumn("own", F.least(F.ceil(F.log2(width)).cast("int"), F.lit(coarsest)))
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("own"), F.least(F.col("own") + reach, F.lit(coarsest)))))
    for i, (lo, hi) in enumerate(axes):
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
        rows = rows.withColumn(f"cell_{i}", F.explode(F.sequence(at(lo), at(hi))))
    return rows.withColumn("is_own", F.col("own") == F.col("level")).drop("own")


def _coarsest(items: DataFrame, axes: list[tuple[str, str]]) -> int:
    """The level of the widest item."""
    widest = F.max(F.greatest(*[F.col(hi) - F.col(lo) for lo, hi in axes], F.lit(2.0**FINEST)))
    last = items.agg(F.ceil(F.log2(widest)).alias("coarsest")).first().coarsest
    return min(COARSEST, max(FINEST, int(last) if last is not None else FINEST))


def meeting(items: DataFrame, group: list[str], axes: list[tuple[str, str]]) -> DataFrame:
    """(group, a_…, b_…): the pairs of a group's items, a of the lesser id, whose bounds meet, found in the cells that both cover."""
    payload = [c for c in items.columns if c not in group]
    cell = [*group, "level", *[f"cell_{i}" for i in range(len(axes))]]
    covered = _cells(items, axes, COARSEST - FINEST, FINEST, _coarsest(items, axes))
    a, b = (covered.select(*cell, F.col("is_own").alias(f"{s}_own"), *[F.col(c).alias(f"{s}_{c}") for c in payload]) for s in "ab")
    meet = (F.col("a_id") < F.col("b_id")) & (F.col("a_own") | F.col("b_own"))
    for lo, hi in axes:
        meet &= (F.col(f"a_{lo}") < F.col(f"b_{hi}")) & (F.col(f"b_{lo}") < F.col(f"a_{hi}"))
    return a.join(b, cell).where(meet).dropDuplicates([*group, "a_id", "b_id"]).drop("a_own", "b_own", *cell[len(group) :])


def _beaten_of_few(items: DataFrame, group: list[str], payload: list[str], too_much: Overlap) -> DataFrame:
    """(group, id) of the items, of groups of at most FEW, that overlap a better kept one too much; `firm` ones stand first and are never
    beaten. The overlaps of a group are one row, best item first, so that when an item's turn comes it is known whether it is kept."""
    a, b = (items.select(*group, *[F.col(c).alias(f"{s}_{c}") for c in (*payload, "firm")]) for s in "ab")
    better = F.col("a_firm") | (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    pairs = a.join(b, group).where(~F.col("b_firm") & better).withColumn("_open", ~F.col("a_firm")).withColumn("_score", -F.col("a_score"))
    place = F.struct(F.col("_open").alias("open"), F.col("_score").alias("score"), F.col("a_id").alias("better"), F.col("b_id").alias("worse"))
    told = too_much(pairs.drop("a_firm", "b_firm")).groupBy(*group).agg(F.sort_array(F.collect_list(place)).alias("told"))
    none = F.array().cast(f"array<{items.schema['id'].dataType.simpleString()}>")
    gone = F.aggregate("told", none, lambda gone, p: F.when(~p["open"] | ~F.array_contains(gone, p["better"]), F.array_union(gone, F.array(p["worse"]))).otherwise(gone))
    return told.select(*group, F.explode(gone).alias("id"))


def keep_best(items: DataFrame, group: list[str], axes: list[tuple[str, str]], too_much: Overlap, least_ratio: float | None, kept_first: DataFrame | None = None) -> DataFrame:
    """(group, id) of the items that are kept: by descending score, then ascending id, each that overlaps no kept one too much.

    `items` has the columns of `group`, id, score and the bounds in `axes`, and what `too_much` reads: that gets pairs of items (group,
    a_..., b_...) that may meet and gives those that overlap too much, with both ids and all columns of other names. `least_ratio` is the least ratio of widths at which two
    items may overlap too much, None if any may. Items of `kept_first` are kept whatever they overlap, and stand against
    the others. Items with a bound that is null or not finite overlap with nothing and are kept; bounds of 2^40 and more are an
    error. A null score, or one that is no number, is the lowest; (group, id) must be unique and without null. Groups of at
    most FEW items, kept_first included, are settled at once. For the others there are as many rounds as the longest chain of items
    each waiting for a better one has; every round is a stored table, and its work is that of the items still undecided.
    """
    key = [*group, "id"]
    known = F.lit(True)
    for c in (c for pair in axes for c in pair):
        far = F.when(F.abs(F.col(c)) >= 2.0**COARSEST, F.raise_error(F.lit(f"{c} is out of range"))).otherwise(True)
        known &= F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf")), False).otherwise(far)
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    items = stored(items.withColumn("score", score).withColumn("placed", known), "items")
    payload = [c for c in items.columns if c not in (*group, "placed")]
    kept = [items.where(~F.col("placed")).select(*key)]
    open_ = items.where("placed").drop("placed")
    firm = None
    if kept_first is not None:
        firm = stored(kept_first.withColumn("score", score).select(*open_.columns), "kept-first")
        kept.append(firm.select(*key))
        firm, open_ = firm.where(known), open_.join(firm.select(*key), key, "left_anti")
    all_ = open_.withColumn("firm", F.lit(False))
    if firm is not None:
        all_ = all_.unionByName(firm.withColumn("firm", F.lit(True)))
    crowded = stored(all_.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*group), "crowded")
    beaten_few = stored(_beaten_of_few(all_.join(crowded, group, "left_anti"), group, payload, too_much), "beaten")
    kept.append(open_.select(*key).join(crowded, group, "left_anti").join(beaten_few, key, "left_anti"))
    open_ = open_.join(crowded, group, "left_semi")
    if firm is not None:
        firm = firm.join(crowded, group, "left_semi")
    coarsest = _coarsest(open_, axes)
    reach = COARSEST - FINEST if least_ratio is None else max(1, next(k for k in range(64) if 2.0**-k <= least_ratio))
    cover = lambda df: _cells(df, axes, reach, FINEST, coarsest)
    cell = [*group, "level", *[f"cell_{i}" for i in range(len(axes))]]
    rank = F.struct(F.col("score"), (-F.col("id")).alias("id"))

    def beaten(by: DataFrame, rest: DataFrame) -> DataFrame:
        """(group, id) of `rest` that overlap one of `by` too much."""
        a, b = (cover(df).select(*cell, F.col("is_own").alias(f"{s}_own"), *[F.col(c).alias(f"{s}_{c}") for c in payload]) for s, df in (("a", by), ("b", rest)))
        met = a.join(b, cell).where(F.col("a_own") | F.col("b_own"))
        return too_much(met.select(*group, *[f"a_{c}" for c in payload], *[f"b_{c}" for c in payload])).select(*group, F.col("b_id").alias("id")).distinct()

    if firm is not None:
        open_ = stored(open_.join(beaten(firm, open_), key, "left_anti"), "undecided")
    while not open_.isEmpty():
        covered = cover(open_).select(*cell, "is_own", "id", "score")
        best = covered.groupBy(*cell).agg(F.max(rank).alias("best"), F.max(F.when(F.col("is_own"), rank)).alias("best_own"))
        first = F.when(F.col("is_own"), rank >= F.col("best")).otherwise(F.col("best_own").isNull() | (rank > F.col("best_own")))
        sure = covered.join(best, cell).groupBy(*key).agg(F.every(first).alias("sure")).where("sure").select(*key)
        won = stored(open_.join(sure, key), "kept")
        kept.append(won.select(*key))
        rest = open_.join(won.select(*key), key, "left_anti")
        open_ = stored(rest.join(beaten(won, rest), key, "left_anti"), "undecided")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def suppress_intervals(rows: DataFrame, key: str, most: float) -> DataFrame:
    """Of each key's intervals (begin, length, score, id), those kept: no kept one shares more than `most` of what the two cover."""

    def too_much(pairs: DataFrame) -> DataFrame:
        shared = F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")
        return pairs.where((shared > 0) & (shared > most * (F.col("a_length") + F.col("b_end") - F.col("b_begin") - shared)))

    items = rows.select(key, "id", "score", "begin", "length", (F.col("begin") + F.col("length")).alias("end"))
    return keep_best(items, [key], [("begin", "end")], too_much, most or None)


def width_ratio(most: float) -> float:
    """The least ratio of widths of two convex shapes that share more than `most` of what they cover: a part of that width of the wider one
    holds at most 1 - (1 - ratio)^2 of its area."""
    return 1 - (1 - most) ** 0.5


def bounds(polygon: Column) -> dict[str, Column]:
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return {"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)}

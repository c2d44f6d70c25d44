"""Boxes on a photo: corners, overlap, suppression of rotated boxes, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import with_value
from .numbering import stored
from .suppression import Overlap, bounds, keep_best, width_ratio


def corners(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    """The corners of a box, its long side upright and, of the two ways round, the top edge higher up."""
    lying = F.when(width > height, angle + np.pi / 2).otherwise(angle)
    axes = with_value(lying, lambda t: F.struct(F.when(F.cos(t) < 0, -F.cos(t)).otherwise(F.cos(t)).alias("cos"), F.when(F.cos(t) < 0, -F.sin(t)).otherwise(F.sin(t)).alias("sin")))
    w, h = F.least(width, height) / 2, F.greatest(width, height) / 2
    points = [(-w, -h), (w, -h), (w, h), (-w, h)]
    return with_value(axes, lambda r: F.array(*[F.array(cx + x * r["cos"] - y * r["sin"], cy + x * r["sin"] + y * r["cos"]) for x, y in points]))


def unrotated(x: Column, y: Column, turns: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a photo that was turned by quarters, on the photo as it was; null for any other number of turns."""
    return F.when(turns == 1, width - y).when(turns == 2, width - x).when(turns == 3, y), F.when(turns == 1, x).when(turns == 2, height - y).when(turns == 3, height - x)


def signed_area(polygon: Column, points: int = 4) -> Column:
    at = lambda i, k: polygon[i % points][k]
    return sum((at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1) for i in range(1, points)), at(0, 0) * at(1, 1) - at(1, 0) * at(0, 1)) / 2


def is_convex(polygon: Column, points: int = 4) -> Column:
    """All turns go one way."""
    step = lambda i, k: polygon[(i + 1) % points][k] - polygon[i % points][k]
    turns = F.array(*[F.signum(step(i, 0) * step(i + 1, 1) - step(i, 1) * step(i + 1, 0)) for i in range(points)])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x)) == points


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """The area that two convex polygons share: what is left of `a` on the inner side of each edge of `b`."""
    area = lambda p: 0.5 * float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) if len(p) > 2 else 0.0
    b = b if area(b) > 0 else b[::-1]
    for start, end in zip(b, np.roll(b, -1, axis=0)):
        if not len(a):
            return 0.0
        side = (end[0] - start[0]) * (a[:, 1] - start[1]) - (end[1] - start[1]) * (a[:, 0] - start[0])
        following, beyond = np.roll(a, -1, axis=0), np.roll(side, -1)
        left = []
        for p, q, s, t in zip(a, following, side, beyond):
            if s >= 0:
                left.append(p)
            if (s > 0 > t) or (s < 0 < t):
                left.append(p + (q - p) * s / (s - t))
        a = np.array(left)
    return abs(area(a))


def overlaps(pairs: DataFrame) -> DataFrame:
    """`pairs` of polygons a and b with iou and of_smaller, batch by batch."""
    columns = [c for c in pairs.columns if c not in ("a", "b")]

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda p: np.array([list(x) for x in p], dtype=float)
        for batch in batches:
            out = []
            for a, b in zip(batch["a"].map(shape), batch["b"].map(shape)):
                sizes = [abs(0.5 * np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) for p in (a, b)]
                both = shared_area(a, b)
                out.append((both / (sum(sizes) - both), both / min(sizes)) if both > 0 else (0.0, 0.0))
            yield batch[columns].assign(iou=[x for x, _ in out], of_smaller=[x for _, x in out])

    types = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns)
    return pairs.mapInPandas(clip, f"{types}, iou double, of_smaller double")


def detected(boxes: DataFrame, least: float, width: str = "w", height: str = "h") -> DataFrame:
    """Boxes of a score of `least` or more; one of them without a positive size ends the job."""
    flat = F.coalesce((F.col(width) <= 0) | (F.col(height) <= 0), F.lit(True))
    return boxes.where(F.col("score") >= least).where(F.when(flat, F.raise_error(F.lit("a box without size")).cast("boolean")).otherwise(True))


def from_corners(points: Column) -> Column:
    """The box of four corners (the top edge first, clockwise), with the upright preference of `corners`."""

    def box(p: Column) -> Column:
        x, y = (lambda i: p[i][0]), (lambda i: p[i][1])
        length = lambda i, j: F.sqrt((x(i) - x(j)) * (x(i) - x(j)) + (y(i) - y(j)) * (y(i) - y(j)))
        middle = lambda at: (at(0) + at(1) + at(2) + at(3)) / 4
        return F.struct(middle(x).alias("x"), middle(y).alias("y"), length(0, 1).alias("w"), length(0, 3).alias("h"), F.atan2(y(1) - y(0), x(1) - x(0)).alias("angle"))

    return with_value(points, lambda p: with_value(box(p), lambda b: corners(b["x"], b["y"], b["w"], b["h"], b["angle"])))


def turned_back(polygon: Column, turns: Column, width: Column, height: Column) -> Column:
    """A box found on a photo that was turned by quarters, on the photo as it was; none was turned: as it is."""
    back = F.transform(polygon, lambda p: F.array(*unrotated(p[0], p[1], turns, width, height)))
    return F.when(turns == 0, polygon).otherwise(from_corners(back))


def _boxes(boxes: DataFrame, photo: list[str]) -> DataFrame:
    """The boxes with their bounds, area (that of the corners, unless it is given) and whether they stand upright, so fill their bounds."""
    area = F.col("area") if "area" in boxes.columns else F.abs(signed_area(F.col("polygon")))
    found = boxes.select(*photo, "id", "score", "polygon", area.alias("area"), *[c.alias(n) for n, c in bounds(F.col("polygon")).items()])
    corner = lambda p: ((p[0] == F.col("x0")) | (p[0] == F.col("x1"))) & ((p[1] == F.col("y0")) | (p[1] == F.col("y1")))
    return found.withColumn("upright", F.forall("polygon", corner) & (F.size(F.array_distinct("polygon")) == 4))


def _overlapping(measure: str, most: float) -> Overlap:
    """Pairs whose bounds meet are clipped; those remain that overlap by more than `most` in `measure`. What two upright boxes share is the
    product of what their sides share: clipping them would decide those that overlap by just `most` by its rounding."""
    side = lambda x: F.least(f"a_{x}1", f"b_{x}1") - F.greatest(f"a_{x}0", f"b_{x}0")
    shared, (a, b) = F.greatest(side("x"), F.lit(0.0)) * F.greatest(side("y"), F.lit(0.0)), map(F.col, ("a_area", "b_area"))
    straight = shared > most * (a + b - shared if measure == "iou" else F.least(a, b))

    def too_much(pairs: DataFrame) -> DataFrame:
        meet = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
        keys = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
        known = F.when(F.col("a_upright") & F.col("b_upright"), straight).alias("straight")
        met = pairs.where(meet).select(*keys, "a_id", "b_id", known, F.col("a_polygon").alias("a"), F.col("b_polygon").alias("b"))
        return overlaps(met.where(F.coalesce("straight", F.lit(True)))).where(F.coalesce("straight", F.col(measure) > most)).drop("straight")

    return too_much


AXES = [("x0", "x1"), ("y0", "y1")]


def suppress_boxes(boxes: DataFrame, photo: list[str], most: float = 0.5) -> DataFrame:
    """Of each photo's boxes (id, score, polygon), those that overlap no kept box of higher score by an IoU above `most`."""
    return keep_best(_boxes(boxes, photo), photo, AXES, _overlapping("iou", most), width_ratio(most) if 0 < most < 1 else None)


def merge_passes(boxes: DataFrame, photo: list[str], most: float = 0.5, of_smaller: float = 0.3) -> DataFrame:
    """Of the boxes (turns, id, score, polygon on the photo as it was) that a detector found on each photo and on its turned copies, those
    that are kept. Upright boxes (turns 0) that overlap no better upright one too much stay as they are. Those of the turned
    passes, after the same choice among themselves, are added by score where they cover at most `of_smaller` of the smaller of
    themselves and every box kept before. An `area` column stands for that of the corners, which have been rounded."""
    found = boxes.select(*photo, "id", "score", "polygon", "turns", *[c for c in ("area",) if c in boxes.columns])
    key = [*photo, "id"]
    one_way = [found.where(w).drop("turns").join(suppress_boxes(found.where(w), photo, most), key) for w in (F.col("turns") == 0, F.col("turns") > 0)]
    upright, turned = (stored(_boxes(b, photo), "pass") for b in one_way)
    return keep_best(turned, photo, AXES, _overlapping("of_smaller", of_smaller), None, kept_first=upright)


def reading_order(boxes: DataFrame, photo: list[str], x: str, y: str, height: str, sequence: str) -> DataFrame:
    """`boxes` with line (from 1, top to bottom) and place (over the photo, line by line, left to right). A line ends where the next
    centre is lower by more than half the median height."""
    middle = boxes.groupBy(*photo).agg(F.median(height).alias("usual"))
    down = Window.partitionBy(*photo).orderBy(y, sequence)
    known = boxes.join(middle, photo)
    starts = F.when(F.col(y) - F.lag(y).over(down) > 0.5 * F.col("usual"), 1).otherwise(0)
    lines = known.withColumn("starts", starts).withColumn("line", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*photo).orderBy("line", x, y, sequence)).cast("long")).drop("usual", "starts")

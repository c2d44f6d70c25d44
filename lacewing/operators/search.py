"""Nearest neighbours of stated queries: exact over all vectors, or within coarse cells whose number is set by an audit.

Both are one plan with one scan of the vectors. Vectors lie in cells and a cell in pieces of a bounded size; a query goes to all
pieces of the cells it is to search, and each task answers a bounded block of queries over one piece, so that only the best few
a query and piece are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .numbering import stored

#: Vectors and queries that one task holds, and bytes of differences worked on at once.
PIECE, SLICE, STEP_BYTES = 8192, 2048, 32 << 20
#: Cells at most, vectors of the sample that a cell is fitted on, and rounds of the fit.
MOST_CELLS, FITTED, ROUNDS = 1024, 32, 8
#: Queries of an audit at most, and the share of true neighbours that the cells searched must hold.
AUDITED, RECALL = 256, 0.97
Answer = Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame]


def distances(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows of the distances of all q to all v, by differences: equal vectors are equally far from any other."""
    step = max(1, STEP_BYTES // max(1, 8 * v.size))
    for lo in range(0, len(q), step):
        apart = q[lo : lo + step, None, :] - v[None, :, :]
        yield lo, np.sqrt(np.einsum("qvd,qvd->qv", apart, apart))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 0))


def _dense(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _answered(queries: DataFrame, vectors: DataFrame, answer: Answer, schema: str) -> DataFrame:
    """`answer` of (distances, block of queries, piece of vectors) for each block and piece of a cell; both sides have vec_id, label,
    embedding and cell. What is broadcast are counts, a row a cell."""
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    asked = queries.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    counts = stored(sizes.join(asked, "cell"), "cells")
    spread = lambda df, own, many, other: df.join(F.broadcast(counts), "cell").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]).cast("int") - 1)))
    columns = ["cell", "piece", "slice", "vec_id", "label", "embedding"]
    v = spread(vectors, "piece", "pieces", ("slice", "slices")).select(*columns)
    q = spread(queries, "slice", "slices", ("piece", "pieces")).select(*[F.col(c).alias(f"q_{c}") for c in columns])

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        q, parts = q.rename(columns=lambda c: c.removeprefix("q_")), []
        if len(q) and len(v):
            left, right = _matrix(q["embedding"]), _matrix(v["embedding"])
            parts = [answer(far, q.iloc[lo : lo + len(far)], v) for lo, far in distances(left, right)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    return q.groupBy("q_cell", "q_piece", "q_slice").cogroup(v.groupBy("cell", "piece", "slice")).applyInPandas(run, schema)


def _nearest(k: int) -> Answer:
    def answer(far: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        ids, own = v["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        far = np.where(own[:, None] == ids[None, :], np.inf, far)
        row, at = np.repeat(np.arange(len(q)), len(ids)), np.tile(np.arange(len(ids)), len(q))
        near = far <= np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1][:, None]  # ties stay for the final order
        near &= np.isfinite(far)
        row, at = row[near.ravel()], at[near.ravel()]
        order = np.lexsort((ids[at], far[row, at], row))
        row, at = row[order], at[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, at = row[first], at[first]
        return pd.DataFrame({"query": own[row], "query_label": q["label"].to_numpy()[row], "vec_id": ids[at], "label": v["label"].to_numpy()[at], "distance": far[row, at]})

    return answer


def _schema(vectors: DataFrame) -> str:
    label = vectors.schema["label"].dataType.simpleString()
    return f"query long, query_label {label}, vec_id long, label {label}, distance double"


def _placed(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id")))
    return ranked.where(F.col("place") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, query_label, vec_id, label, distance, place): the k nearest of all `vectors` (vec_id, label, embedding) but itself to each of
    `queries`, exactly; ties in distance go by vec_id. Embeddings are of one length, without null."""
    one = F.lit(0)
    return _placed(_answered(queries.withColumn("cell", one), vectors.withColumn("cell", one), _nearest(k), _schema(vectors)), k)


def nearest_labels(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, label, distance): the nearest vector of the two labels nearest to each query, exactly. A piece gives its two, which hold
    what it has of the two of all."""

    def answer(far: np.ndarray, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        far = np.where(q["vec_id"].to_numpy()[:, None] == v["vec_id"].to_numpy()[None, :], np.inf, far)
        names, code = np.unique(v["label"].to_numpy(), return_inverse=True)
        least = np.full((len(q), len(names)), np.inf)
        for c in range(len(names)):
            least[:, c] = far[:, code == c].min(axis=1)
        best = np.argsort(least, axis=1, kind="stable")[:, :2]
        row = np.repeat(np.arange(len(q)), best.shape[1])
        out = pd.DataFrame({"query": q["vec_id"].to_numpy()[row], "label": names[best.ravel()], "distance": least[row, best.ravel()]})
        return out[np.isfinite(out["distance"])]

    one, label = F.lit(0), vectors.schema["label"].dataType.simpleString()
    found = _answered(queries.withColumn("cell", one), vectors.withColumn("cell", one), answer, f"query long, label {label}, distance double")
    return found.groupBy("query", "label").agg(F.min("distance").alias("distance"))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres of the sample in one task: the first by hash, then rounds of assignment and means; a centre without vectors takes the
    vector farthest from its own."""
    nth, held = [], []
    for b in batches:
        nth.append(b.column(0).to_numpy())
        held.append(_dense(b.column(1)))
    x = np.concatenate(held)
    x = x[np.lexsort((*x.T[::-1], np.concatenate(nth)))]
    centres = x[: max(1, len(x) // FITTED)].copy()
    step = max(1, STEP_BYTES // (8 * len(centres)))
    for _ in range(ROUNDS):
        own, apart = np.zeros(len(x), int), np.zeros(len(x))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            far = (part * part).sum(1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(1)[None, :]
            own[lo : lo + step], apart[lo : lo + step] = far.argmin(1), far.min(1)
        away = np.argsort(-apart, kind="stable")
        for c in range(len(centres)):
            mine = own == c
            centres[c] = x[mine].mean(0) if mine.any() else x[away[c]]
    yield pa.RecordBatch.from_arrays([pa.array(centres.tolist(), pa.list_(pa.float64()))], names=["centre"])


def centres(vectors: DataFrame) -> np.ndarray:
    """At most MOST_CELLS centres, the square root of the vectors' number where that is less, fitted on FITTED vectors each: the least
    by hash."""
    cells = max(1, min(MOST_CELLS, int(vectors.count() ** 0.5)))
    sample = vectors.select(F.xxhash64("vec_id", "embedding").alias("nth"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("nth").limit(cells * FITTED)
    return np.array([r.centre for r in sample.repartition(1).mapInArrow(_fitted, "centre array<double>").collect()], float)


def cell_rows(batches: Iterator[pa.RecordBatch], place: int, c: np.ndarray, probes: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows once for each of their `probes` nearest of the centres `c`, in batches of about `most` bytes: a vector of many cells becomes
    many rows."""
    step = max(1, most // (8 * (len(c) + probes * c.shape[1])))
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            far = (c * c).sum(1)[None, :] - 2 * _dense(batch.column(place)) @ c.T
            best = np.argsort(far, axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([*(col.take(row) for col in batch.columns), pa.array(best.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, best.shape[1] + 1), len(best)), pa.int32())], names=[*batch.schema.names, "cell", "nth"])


def in_cells(rows: DataFrame, fitted: np.ndarray, probes: int) -> DataFrame:
    """`rows` once for each of its `probes` nearest cells, with cell and nth (from 1); ties go to the lower cell."""
    held, place, most = rows.sparkSession.sparkContext.broadcast(fitted), rows.columns.index("embedding"), STEP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cell_rows(batches, place, held.value, probes, most)

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("cell", IntegerType()), StructField("nth", IntegerType())]))


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, k: int, recall: float = RECALL) -> tuple[DataFrame, int, float]:
    """Like `nearest`, over the cells nearest to each query; their number, and the share of true neighbours that these cells hold in the
    audit. Distances are exact.

    A bounded sample of the queries, the least by hash, is answered exactly; the cells searched are as many as hold `recall` of its
    neighbours. With all cells searched nothing is missed. An empty table of vectors or queries gives no rows.
    """
    vectors, queries = (df.select("vec_id", "label", "embedding") for df in (vectors, queries))
    if vectors.isEmpty() or queries.isEmpty():
        return nearest(queries, vectors, k), 0, 1.0
    fitted = centres(vectors)
    placed = stored(in_cells(vectors, fitted, 1).drop("nth"), "placed")
    sample = stored(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDITED), "sample")
    truth = nearest(sample, placed.drop("cell"), k).select("query", "vec_id")
    cells = in_cells(sample, fitted, len(fitted)).select(F.col("vec_id").alias("query"), "cell", "nth")
    depth = truth.join(placed.select("vec_id", "cell"), "vec_id").join(cells, ["query", "cell"]).groupBy("nth").count()
    held, total = {r.nth: r["count"] for r in depth.collect()}, 0  # a row a cell at most
    wanted, probes = sum(held.values()), 0
    while probes < len(fitted) and (not probes or total < recall * wanted):
        probes += 1
        total += held.get(probes, 0)
    found = _answered(in_cells(queries, fitted, probes).drop("nth"), placed, _nearest(k), _schema(vectors))
    return _placed(found, k), probes, total / wanted if wanted else 1.0

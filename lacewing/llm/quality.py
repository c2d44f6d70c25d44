"""Quality: a byte-level convolutional network, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, steps, stored, string_bytes, table

#: What a fit sees at most: labelled documents of each class, whole ones.
PER_CLASS = 1200
CHUNK, OVERLAP, STRIDE, WIDTH, EMBED, FILTERS = 256, 32, 2, 8, 6, 16
ROUNDS, BATCH, RATE, LIMIT = 350, 32, 0.01, 6.0
#: A byte counts as a repetition if the RUN bytes up to it equal those a period before, for a period of PERIODS bytes.
RUN, PERIODS = 12, range(3, 26)
THRESHOLD = 0.7


def repeats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bytes end a run that repeats what stood one period before in the same row."""
    out = np.zeros(len(data), bool)
    behind = np.minimum(np.arange(len(data)) - np.repeat(off[:-1], np.diff(off)), 255).astype(np.uint8)
    for period in PERIODS:
        if len(data) <= period + RUN:
            break
        same = data[period:] == data[:-period]
        for shift in (1, 2, 4, RUN - 8):
            same = same[shift:] & same[:-shift]
        out[-len(same) :] |= same & (behind[-len(same) :] >= period + RUN - 1)
    return out


def chunks_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover each row, as symbols (byte, and 256 more for a repetition), and their rows. An
    empty row has one chunk; what a row leaves of its last one is symbol 0."""
    symbols = np.concatenate([data.astype(np.uint16) + 256 * repeats(data, off).astype(np.uint16), np.zeros(CHUNK, np.uint16)])
    step = CHUNK - OVERLAP
    count = np.maximum(1, -(-(np.diff(off) - OVERLAP) // step))
    row = np.repeat(np.arange(len(count)), count)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
    out = symbols[np.minimum(start[:, None] + np.arange(CHUNK), len(symbols) - 1)]
    out[np.arange(CHUNK) >= (off[1:][row] - start)[:, None]] = 0
    return out, row


class Network:
    """Embedding, convolution, max-pooling over a chunk, a bounded score a chunk; a row's logit is the mean of its chunks' scores."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (512, EMBED)), "w": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), "c": np.zeros(FILTERS), "o": rng.normal(0, 0.3, FILTERS), "b": np.zeros(1)}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter at each place: (place, symbol, filter)."""
        return np.einsum("se,wef->wsf", self.p["e"], self.p["w"]).astype(np.float32)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, where: bool = False):
        places = (CHUNK - WIDTH) // STRIDE + 1
        total = np.zeros((len(chunks), places, FILTERS), np.float32)
        for j in range(WIDTH):
            total += tables[j].take(chunks[:, j : j + places * STRIDE : STRIDE], 0)
        at = total.argmax(1) if where else None
        return np.maximum(total.max(1) + self.p["c"], 0), at

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return LIMIT * np.tanh(((pooled * self.p["o"]).sum(1) + self.p["b"]) / LIMIT)

    def learn(self, docs: list[np.ndarray], label: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        groups = [np.flatnonzero(label == k) for k in (0, 1)]
        for step in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(g, batch // 2) for g in groups if len(g)])
            chunks = np.concatenate([docs[i] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
            n = np.bincount(row)
            pooled, at = self.pooled(chunks, self.tables(), True)
            s = self.scores(pooled)
            p = 1 / (1 + np.exp(-np.bincount(row, s) / n))
            ds = ((p - label[pick]) / len(pick))[row] / n[row] * (1 - (s / LIMIT) ** 2)
            g = {"o": pooled.T @ ds + 1e-4 * self.p["o"], "b": np.array([ds.sum()])}
            dm = ds[:, None] * self.p["o"] * (pooled > 0)
            g["c"] = dm.sum(0)
            g["e"], g["w"] = np.zeros_like(self.p["e"]), np.zeros_like(self.p["w"])
            for j in range(WIDTH):
                seen = np.take_along_axis(chunks, at * STRIDE + j, 1)
                g["w"][j] = np.einsum("nfe,nf->ef", self.p["e"][seen], dm)
                np.add.at(g["e"], seen.ravel(), (dm[:, :, None] * self.p["w"][j].T).reshape(-1, EMBED))
            for name in self.p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
                self.p[name] = (self.p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def read(self, data: np.ndarray, off: np.ndarray, tables: np.ndarray, at_once: int = 256) -> np.ndarray:
        """A probability for each row, from all its chunks."""
        chunks, row = chunks_of(data, off)
        s = np.concatenate([self.scores(self.pooled(chunks[lo : lo + at_once], tables)[0]) for lo in range(0, len(chunks), at_once)])
        logit = np.bincount(row, s, len(off) - 1) / np.bincount(row, minlength=len(off) - 1)
        return 1 / (1 + np.exp(-logit))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], modulo: int, left: int) -> DataFrame:
    """(text, label, nth) of a bounded sample: label rows whose crc32(doc_id) mod `modulo` isn't `left`, of each class the
    `most[class]` least by hash. Only those ids, a proven bound, are broadcast to the documents."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where((remainder("doc_id", modulo) != left) & F.col("label").isin(*most)).distinct()
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("label"))
    some = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(most.values())).where(F.col("nth") <= bound)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "sample")
    if rows.count() > 2 * sum(most.values()):  # ids that repeat
        rows = rows.orderBy("label", "nth", F.xxhash64("text"), "text").limit(2 * sum(most.values()))
    return rows.select("text", "label", "nth")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """A network from labels whose crc32(doc_id) mod 4 isn't 2: at most `per_class` documents a class, the least by hash, read
    whole in one task. Labels other than 0 and 1 are ignored; rows that repeat an id are all seen, and an id with both labels
    counts for both. With no labels the network stays as it begins."""
    rows = labelled(docs, labels, "quality", {0: per_class, 1: per_class}, 4, 2)
    network = Network()
    network.p = pickle.loads(rows.repartition(1).mapInArrow(_fitted, "model binary").first()["model"])
    return network


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights from the bounded sample, which one task holds."""
    rows = sorted(((label, nth, text or "") for batch in batches for text, label, nth in zip(*(c.to_pylist() for c in batch.columns))))
    network, seen = Network(), [chunks_of(*string_bytes(pa.array([text])))[0] for _, _, text in rows]
    if seen:
        network.learn(seen, np.array([label for label, _, _ in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.p)], pa.binary())], names=["model"])


def score(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text and nothing else; null and empty texts score as
    an empty chunk. A score that equals the threshold is predicted 1; rows that repeat give rows that repeat."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = net.tables()
        for batch in batches:
            for step in steps(batch, "text"):
                p = net.read(*string_bytes(step.column(2)), tables)
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(read, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

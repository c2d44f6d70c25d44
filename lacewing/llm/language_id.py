"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, steps, stored, string_bytes, table

#: What a fit sees at most: documents of a language, whole ones.
PER_LANGUAGE = 200
HIDDEN, PIECE_BYTES, ROUNDS, BATCH, RATE = 8, 64, 260, 192, 0.02
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def pieces_of(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes in pieces of `size` (the last one of a row filled with zeros), each piece's row and length."""
    count = -(-np.diff(off) // size)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][row] + nth * size
    length = np.minimum(size, off[1:][row] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = padded[start[:, None] + np.arange(size)]
    if len(out):
        out[np.arange(size) >= length[:, None]] = 0
    return out, row, length


class Network:
    """Two gated recurrent units, one from each side, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, max(1, len(languages))
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "h": rng.normal(0, 0.3, (2, hidden, 3 * hidden)),
            "o": rng.normal(0, 0.3, (2 * hidden, k)), "b": np.zeros(k),
        }
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        self.hidden = hidden

    def states(self, text: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States after each byte of each piece: (time, 2, piece, hidden), the second from the right."""
        n, time, d = len(text), text.shape[1], self.hidden
        both = np.stack([text.T, text.T[::-1]], 1).astype(np.intp)
        out, h = np.empty((time, 2, n, d), np.float32), np.zeros((2, n, d), np.float32)
        for t in range(time):
            x = np.stack([self.p["x"][0][both[t, 0]], self.p["x"][1][both[t, 1]]])
            u = h @ self.p["h"]
            gates = sigmoid(x[..., : 2 * d] + u[..., : 2 * d])
            z, r = gates[..., :d], gates[..., d:]
            c = np.tanh(x[..., 2 * d :] + r * u[..., 2 * d :])
            if keep is not None:
                keep[t] = h, z, r, c, u[..., 2 * d :]
            h = h + z * (c - h)
            out[t] = h
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probability of each language at each byte: (piece, time, language)."""
        left, right = states[:, 0].transpose(1, 0, 2), states[::-1, 1].transpose(1, 0, 2)
        logit = left @ self.p["o"][: self.hidden] + right @ self.p["o"][self.hidden :] + self.p["b"]
        logit -= logit.max(-1, keepdims=True)
        np.exp(logit, out=logit)
        return logit / logit.sum(-1, keepdims=True)

    def learn(self, text: np.ndarray, mask: np.ndarray, language: np.ndarray, owner: np.ndarray | None = None, rounds: int = ROUNDS, batch: int = BATCH, seed: int = 11) -> None:
        """Backpropagation through time on the cross-entropy of every byte's label, with Adam. A batch draws documents, the
        `owner` of a piece, and a piece of each; without owners it draws pieces."""
        rng, d = np.random.default_rng(seed), self.hidden
        m, v = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            if owner is None:
                pick = rng.integers(0, len(text), min(batch, len(text)))
            else:
                head = np.searchsorted(owner, rng.choice(owner[np.diff(owner, prepend=-1) > 0], min(batch, len(text))))
                count = np.searchsorted(owner, owner[head], "right") - head
                pick = head + (rng.random(len(head)) * count).astype(int)
            x, w, y, keep = text[pick], mask[pick].astype(np.float32), language[pick], {}
            states = self.states(x, keep)
            error = self.labels(states)
            error[np.arange(len(x)), :, y] -= 1
            error *= (w / max(1.0, w.sum()))[..., None]
            g = {n: np.zeros_like(p) for n, p in self.p.items()}
            back = np.stack([(error @ self.p["o"][:d].T).transpose(1, 0, 2), (error @ self.p["o"][d:].T).transpose(1, 0, 2)[::-1]], 1)
            g["b"] = error.sum((0, 1))
            flat = error.reshape(-1, error.shape[-1])
            g["o"][:d] = states[:, 0].transpose(1, 0, 2).reshape(-1, d).T @ flat
            g["o"][d:] = states[::-1, 1].transpose(1, 0, 2).reshape(-1, d).T @ flat
            both, dh, time = np.stack([x.T, x.T[::-1]], 1).astype(np.intp), np.zeros_like(back[0]), x.shape[1]
            for t in reversed(range(time)):
                h, z, r, c, uc = keep[t]
                dh = dh + back[t]
                dc = dh * z * (1 - c * c)
                dz, dr = dh * (c - h) * z * (1 - z), dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], -1)
                g["h"] += h.transpose(0, 2, 1) @ du
                dx = np.concatenate([dz, dr, dc], -1)
                for side in (0, 1):
                    np.add.at(g["x"][side], both[t, side], dx[side])
                dh = dh * (1 - z) + du @ self.p["h"].transpose(0, 2, 1)
            for n in self.p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
                self.p[n] -= (RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def read(self, data: np.ndarray, off: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pooled probabilities (row, language) over all bytes, and each piece's row, length and own probabilities."""
        text, row, length = pieces_of(data, off, PIECE_BYTES)
        own = np.zeros((len(text), len(self.languages)))
        for lo in range(0, len(text), at_once):
            part = text[lo : lo + at_once]
            label = self.labels(self.states(part))
            label *= (np.arange(PIECE_BYTES) < length[lo : lo + at_once, None])[..., None]
            own[lo : lo + at_once] = label.sum(1)
        pooled = np.stack([np.bincount(row, own[:, k], len(off) - 1) for k in range(own.shape[1])], 1) if own.shape[1] else np.zeros((len(off) - 1, 0))
        return pooled / np.maximum(1, np.diff(off))[:, None], row, length, own


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """A network from (doc_id, text, lang): rows whose crc32(doc_id) mod 5 isn't 0, of each language the `per_language`
    least by hash (rows of one id by the hash of their text; equal rows count once), read whole in one task. Pieces of all
    of a document are drawn from, a shorter document's as often as a longer one's."""
    known = docs.where((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = known.select("doc_id", "lang", F.xxhash64("text").alias("own"), "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "own")
    some = rows.select("doc_id", "lang", "own").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    some = stored(some.groupBy("doc_id", "lang", "own").agg(F.min("nth").alias("nth")), "sample")
    sample = stored(rows.join(F.broadcast(some), ["doc_id", "lang", "own"]).select("lang", "nth", "text"), "texts")
    languages, weights = pickle.loads(sample.repartition(1).mapInArrow(_fitted, "model binary").first()["model"])
    network = Network(languages)
    network.p = weights
    return network


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The languages and weights from the bounded sample, which one task holds."""
    rows = sorted({(lang, nth, text) for batch in batches for lang, nth, text in zip(*(c.to_pylist() for c in batch.columns))})
    languages = sorted({lang for lang, _, _ in rows})
    network = Network(languages)
    if len(languages) > 1:
        data, off = string_bytes(pa.array([text for _, _, text in rows], pa.string()))
        text, row, length = pieces_of(data, off, PIECE_BYTES)
        network.learn(text, np.arange(PIECE_BYTES) < length[:, None], np.array([languages.index(lang) for lang, _, _ in rows])[row], row)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((languages, network.p))], pa.binary())], names=["model"])


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of every row of `docs`.

    All bytes of the text are labelled; `score` is the mean probability of the predicted language. `spans` are
    byte ranges (start, end, lang) whose pieces agree. Null, empty and letterless texts, and all texts
    if nothing could be learned, give 'und', score 0 and no spans. Rows that repeat give rows that repeat. Of languages
    that tie, the first by name is predicted.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(network)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for step in steps(batch, "text"):
                data, off = string_bytes(step.column(2))
                letters = np.array(step.column(3)) & bool(net.languages)
                pooled, row, length, own = net.read(data, off)
                best = pooled.argmax(1) if net.languages else np.zeros(len(off) - 1, int)
                score = np.where(letters, pooled[np.arange(len(best)), best] if net.languages else 0.0, 0.0)
                top = own.argmax(1) if len(own) and net.languages else np.zeros(0, int)
                start = np.concatenate([[0], np.cumsum(length)])[:-1] - off[:-1][row] if len(row) else np.zeros(0, int)
                turn = np.flatnonzero(np.diff(top, prepend=-1) | np.diff(row, prepend=-1)) if len(top) else np.zeros(0, int)
                turn = turn[letters[row[turn]]]
                last = np.concatenate([np.flatnonzero(np.diff(top) | np.diff(row)), [len(top) - 1]]).astype(int) if len(top) else np.zeros(0, int)
                last = last[letters[row[last]]]
                flat = pa.StructArray.from_arrays([pa.array(start[turn], pa.int64()), pa.array(start[last] + length[last], pa.int64()), pa.array([net.languages[k] for k in top[turn]], pa.string())], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[turn], np.arange(len(off))), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array([net.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return rows.mapInArrow(read, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).drop("spans")

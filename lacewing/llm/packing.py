"""Best-fit packing of tokenized documents into sequences of one length.

What is planned are lengths, not documents: a histogram of at most `capacity` rows reaches the driver, best-fit places whole
runs of equal pieces in whole runs of equally filled sequences, and each piece takes the slot of its rank within its length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, named, numbered, steps, stored, string_bytes, table, word_spans

CAPACITY, END = 2048, 0
#: Bytes of text that are tokenized together.
TOKENIZED_BYTES = 6 << 20
#: Distinct pieces of text whose ids a worker keeps; past that it forgets them all and goes on.
KNOWN = 800_000
#: The pattern of the tokenizers for which words are cut further, as their files state it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAN = "length int, from_rank long, pieces long, sequence long, each long, offset long"


#: Bytes as letters, digits, an apostrophe, other signs, and the rest (blanks, controls and what isn't ASCII).
_LETTER, _DIGIT, _QUOTE, _SIGN, _REST = range(5)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[39] = _QUOTE
#: Whether PATTERN ends one match and begins another between two bytes, whatever stands around them: a letter never shares a match
#: with a sign after it, a digit with nothing, and a sign with a letter after it only if it is an apostrophe.
_CUT = np.zeros((5, 5), bool)
_CUT[_LETTER, [_QUOTE, _SIGN]] = _CUT[_SIGN, _LETTER] = True
_CUT[_DIGIT, :_REST] = _CUT[:_REST, _DIGIT] = True


class Pieces:
    """Ids of pieces of text, each tokenized once, for tokenizers that never join what white space separates.

    Where the tokenizer lower-cases and splits by PATTERN, words are lower-cased (A-Z) and cut before, between ASCII characters that it
    always separates, so that there are fewer pieces to know. Words with one of its added tokens stay whole.
    """

    def __init__(self, tokenizer: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, spec = Tokenizer.from_str(tokenizer), end, json.loads(tokenizer)
        added = [t["content"] for t in spec["added_tokens"]]
        if any(re.search(r"\s", t) for t in added):
            raise ValueError("an added token with white space may lie across words")
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        steps = [(n["type"], n.get("pattern")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [(n["type"], n.get("pattern")) for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.fine = steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] and split[:1] == [("Split", {"Regex": PATTERN})]
        self.forget()

    def forget(self) -> None:
        """Entry 0 is the end of a text."""
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.many = np.array([self.end], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def entries(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.forget()
        at = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            texts = [pieces[i] for i in new.tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            many = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = np.arange(len(self.many), len(self.many) + len(new))
            self.known.update(zip(texts, at[new].tolist()))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(many) - many])
            self.many = np.concatenate([self.many, many])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), "<u4", many.sum())])
        return at

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes as they are to be looked up, start and end of each piece, and for each row the index of its first (n+1 numbers)."""
        starts, ends, first = word_spans(data, off)
        if not self.fine or not len(starts):
            return data, starts, ends, first
        kind = _CLASS[data]
        begins = np.concatenate([[False], _CUT[kind[:-1], kind[1:]]])
        begins[off[:-1][off[:-1] < len(data)]] = False  # a text's first byte follows nothing
        folded = FOLD[data]
        for m in self.added.finditer(data.tobytes()) if self.added else ():
            word = np.searchsorted(starts, m.start(), "right") - 1
            begins[starts[word] : ends[word]], folded[starts[word] : ends[word]] = False, data[starts[word] : ends[word]]
        cuts = np.flatnonzero(begins)
        return folded, np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), first + np.searchsorted(cuts, np.append(starts, len(data)))[first]


@functools.lru_cache(maxsize=1)
def loaded(tokenizer: str, end: int) -> Pieces:
    """A worker's one tokenizer, whatever its tasks."""
    return Pieces(tokenizer, end)


def token_ids(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each closed by the end, and the n+1 offsets of the texts in them."""
    data, off = string_bytes(texts)
    data, starts, ends, first = known.cut(data, off)
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a piece may begin where one ends
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    entries = known.entries(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)]
    entries = np.insert(entries, first[1:], 0)
    taken = known.many[entries]
    at = np.concatenate([[0], np.cumsum(taken)])
    ids = known.ids[np.repeat(known.begin[entries] - at[:-1], taken) + np.arange(at[-1])]
    return ids, at[np.concatenate([[0], first[1:] + np.arange(1, len(first))])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document of `docs`: its ids and `end`, cut every `capacity` ids.

    A null text counts as empty: one piece with `end` alone. Repeated rows are documents of their own. An empty table gives no
    rows; other columns take no part. `tokenizer` is the path of a tokenizer file on the driver, which goes to the executors by
    broadcast; it must cut at white space and never join across it.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    df = docs.select(named(key).alias("key"), "text")
    kind = df.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", TOKENIZED_BYTES):
                ids, off = token_ids(part.column(1), loaded(shipped.value, end))
                count = -(-np.diff(off) // capacity)
                row = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                a = off[row] + start
                b = np.minimum(a + capacity, off[row + 1])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                out = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(b - a, pa.int32()), pa.array(crc, pa.int64())]
                if with_ids:
                    cuts = np.concatenate([a, off[-1:]]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return df.mapInArrow(run, schema).withColumnRenamed("key", key)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for `counts[length]` pieces of each length, longest first, each in the sequence with the least room that holds it.

    A row (length, from_rank, pieces, sequence, each, offset) places the pieces of ranks from_rank onwards in the sequences from
    `sequence` onwards, `each` of them in one after another from `offset`. Sequences equally full are one run, which the pieces of
    a length change from one end, so the rows are bounded by the capacity and not by the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, sequences)
    sizes: list[int] = []  # the keys of `room`, ascending
    plan, used = [], 0

    def keep(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(sizes, free)
                room[free] = []
            room[free].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = room[free].pop()
            else:
                free, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = free // length
            full = min(n, left // each)
            rest = 0 if full == n else left - full * each
            if full:
                plan.append((length, rank, full * each, first, each, capacity - free))
                keep(free - each * length, first, full)
            if rest:
                plan.append((length, rank + full * each, rest, first + full, rest, capacity - free))
                keep(free - rest * length, first + full, 1)
            keep(free, first + full + bool(rest), n - full - bool(rest))
            if free in room and not room[free]:
                del room[free]
                sizes.remove(free)
            left -= full * each + rest
            rank += full * each + rest
    return plan


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The pieces of `pieces` with the sequence each goes to and its offset there.

    No sequence is longer than `capacity` and none has a gap. Pieces of one length are ranked by key, number, checksum and, if
    equal in all, as they lie in the stored table.
    """
    spark = parts.sparkSession
    at = "row"
    parts = stored(parts.withColumn(at, F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit(counts, capacity), PLAN).withColumnRenamed("length", "of_length")
    ranked = numbered(parts, ["length"], [named(key), F.col("piece"), F.col("ids_crc32"), F.col(at)], "pieces").drop(at, "members")
    slot = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("pieces"))
    nth = F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(plan), slot)  # the plan's rows are bounded by the capacity
    return placed.select(*[c for c in parts.columns if c != at], (F.col("sequence") + F.expr("(rank - from_rank) div each")).alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids: at most `capacity` ids a row."""
    runs = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.col("runs.ids"))
    return packed.groupBy("sequence_id").agg(runs.alias("runs")).select("sequence_id", F.size(ids).alias("length"), ids.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")

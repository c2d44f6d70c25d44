"""Substring dedup: FM-indexes over wavelet trees find word windows that repeat anywhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, mix, span_hashes, steps, stored, string_bytes, table, word_spans

#: Words of a window; of an anchor; of a symbol in an index (a window is a whole number of symbols).
WINDOW, ANCHOR, SYMBOL = 35, 8, 5
#: Windows of a run at most; words of a shard; different runs of an anchor above which they are dealt out anew by one anchor more.
RUN, SHARD_WORDS, ANCHOR_RUNS = 28, 1_000_000, 1000
#: By how many of its windows' least grams an anchor's runs are dealt out, if those of the count before are too many; the last is all.
DEALT_BY = (1, 4, 12, 28)
#: Runs that are cut into windows at a time.
RUNS_AT_ONCE = 256


# --- the index ---------------------------------------------------------------------------------------


class WaveletTree:
    """Rank of a symbol in a sequence: a level of bits for each bit of the symbols, packed, with a count every 64."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.size = [], len(sequence)
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit) & 1 == 1
            packed = np.packbits(np.concatenate([ones, np.zeros(-len(ones) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]).astype(np.int32)
            self.levels.append((bit, packed, counts, len(ones) - int(ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.first = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search over a weighted text of symbols 1 and up, in which 0 ends a sequence.

    Suffixes are sorted by doubling to a depth that covers every pattern asked for; a range's weight is the number of places,
    copies included, where the pattern stands.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n = len(text)
        rank, reach = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while reach < depth:
            following = np.zeros(n, np.int64)
            following[: n - reach] = rank[reach:] + 1
            rank = np.unique(rank * (n + 1) + following, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        symbols = int(text.max(initial=0)) + 1
        self.tree = WaveletTree(text[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.before[symbol], self.before[symbol + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with one more symbol in front."""
        base = self.before[symbol]
        return base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)

    def found(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]


def matching_statistics(sequences: list[np.ndarray], copies: np.ndarray, window: int = WINDOW, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each place of each word sequence where a window of it ends, the length in words of the longest stretch that ends there and stands at
    two places or more of the weighted sequences: the sequences are indexed, and each is streamed backwards through the index.

    A symbol is `symbol` consecutive words, and a sequence is read in as many phases, so that lengths are counted in symbols, and a
    window is a whole number of them. All places search at once and go on, past the window, for as long as what they have
    matched stands at two places.
    """
    size = np.array([len(s) for s in sequences])
    first = np.concatenate([[0], np.cumsum(size)])
    words = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
    grams = gram_hashes(words, symbol)
    number = np.unique(grams, return_inverse=True)[1].astype(np.int64) + 1
    # the phases of each sequence one after another, each ended by 0
    owner = np.repeat(np.arange(len(size)), size)[: len(grams)]
    inside = np.arange(len(grams)) + symbol <= first[owner + 1]
    at, own = np.flatnonzero(inside), owner[inside]
    local = at - first[own]
    order = np.lexsort((local, local % symbol, own))
    at, own, local = at[order], own[order], local[order]
    ends = np.concatenate([(np.diff(own) != 0) | (np.diff(local) != symbol), [True]]) if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) + np.cumsum(ends) - ends
    text, weight = np.zeros(len(at) + int(ends.sum()), np.int64), np.zeros(len(at) + int(ends.sum()), np.int64)
    text[place], weight[place] = number[at], copies[own]
    count = np.maximum(0, size - window + 1)
    length = np.zeros(int(count.sum()), np.int32)
    if not len(length):
        return [np.zeros(0, np.int32) for _ in sequences]
    index = FMIndex(text, weight, int(size.max()) // symbol)
    begin = np.repeat(first[:-1], count)
    end = begin + np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count) + window
    for lo in range(0, len(length), 1 << 18):
        live = np.arange(lo, min(len(length), lo + (1 << 18)))
        at = end[live] - symbol
        a, b = index.start(number[at])
        while True:
            more = index.found(a, b) >= 2
            live, at, a, b = live[more], at[more], a[more], b[more]
            length[live] += symbol
            more = at - symbol >= begin[live]
            live, at, a, b = live[more], at[more] - symbol, a[more], b[more]
            if not len(live):
                break
            a, b = index.extend(number[at], a, b)
    return np.split(length, np.cumsum(count)[:-1])


def repeated_windows(sequences: list[np.ndarray], copies: np.ndarray, window: int = WINDOW, symbol: int = SYMBOL) -> list[np.ndarray]:
    """Which windows of each word sequence stand at two places or more: those that a repeated stretch of their length or more ends with."""
    return [m >= window for m in matching_statistics(sequences, copies, window, symbol)]


# --- the corpus --------------------------------------------------------------------------------------


def _row() -> list[Column]:
    """What names a row: two hashes of its id and text. Rows equal in both are one document and get the same result."""
    doc = F.col("doc_id").cast("string")
    return [F.xxhash64(doc, "text").alias("row"), F.xxhash64(F.lit("row"), "text", doc).alias("row2")]


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = string_bytes(col)
    starts, ends, first = word_spans(data, off)
    return span_hashes(data, starts, ends), first


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(len(words) + 1, np.uint64(0xD6E8FEB86659FD93))
    power[0] = 1
    inverse = np.full(len(words) + 1, np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64)))
    inverse[0] = 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * np.multiply.accumulate(power)[:-1], out=sums[1:])
    return sums, np.multiply.accumulate(inverse)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, run, row, row2, start, n, twice): windows in a row that share their anchor, the least hash of their ANCHOR-word grams.
    `run` is the hash of all its words; `twice` says that one of its windows stands in it again, as in periodic text."""
    for batch in batches:
        for step in steps(batch, "text"):
            words, first = _words(step.column(2))
            low = gram_hashes(words, ANCHOR)
            span, have = WINDOW - ANCHOR + 1, 1
            while 2 * have <= span:
                low = np.minimum(low[:-have], low[have:])
                have *= 2
            if span > have:
                low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(low)]
            at = np.flatnonzero(np.arange(len(low)) + WINDOW <= first[row + 1])
            if not len(at):
                continue
            new = np.concatenate([[True], (np.diff(low[at]) != 0) | (np.diff(row[at]) != 0)])
            head = np.flatnonzero(new)
            since = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
            head = np.flatnonzero(since % RUN == 0)
            n = np.diff(np.concatenate([head, [len(at)]]))
            start = at[head]
            sums, inverse = _sums(words)
            run = mix((sums[start + n + WINDOW - 1] - sums[start]) * inverse[start] + n.astype(np.uint64))
            own = row[start]
            digest, of, twice = (sums[at + WINDOW] - sums[at]) * inverse[at], np.repeat(np.arange(len(n)), n), np.zeros(len(n), bool)
            for period in range(1, int(n.max())):
                again = np.flatnonzero(digest[period:] == digest[:-period])
                twice[of[again[of[again] == of[again + period]]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(low[start].view(np.int64)), pa.array(run.view(np.int64)), step.column(0).take(pa.array(own)), step.column(1).take(pa.array(own)), pa.array((start - first[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["anchor", "run", "row", "row2", "start", "n", "twice"])
        pa.default_memory_pool().release_unused()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, run, copies, n, words) of the listed runs of each text."""
    for batch in batches:
        for step in steps(batch, "text"):
            words, first = _words(step.column(0))
            listed = step.column(1)
            of = np.repeat(np.arange(step.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            start, n, anchor, run, copies = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            lo = first[of] + start
            raw = words.view(np.uint8)
            pieces = [raw[8 * a : 8 * (a + m + WINDOW - 1)].tobytes() for a, m in zip(lo.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run), pa.array(copies), pa.array(n), pa.array(pieces, pa.binary())], names=["anchor", "run", "copies", "n", "words"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, mask): builds the shard's index from its runs and streams them through it; a bit for each window that lies in a stretch, at least
    as long, that ends with it and is repeated."""
    runs, copies, words = [], [], []
    for batch in batches:
        runs.append(batch.column(1).to_numpy())
        copies.append(batch.column(2).to_numpy())
        words += [np.frombuffer(w.as_py(), np.uint64) for w in batch.column(4)]
    if words:
        found = matching_statistics(words, np.concatenate(copies))
        mask = np.array([int(((m >= WINDOW).astype(np.int64) << np.arange(len(m))).sum()) for m in found], np.int64)
        hit = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)[hit]), pa.array(mask[hit])], names=["run", "mask"])


def _split(known: int, grams: int):
    """(parent, at, anchor, run, n, copies, words) of the parts of each run whose windows share so many least grams, of which `known` are shared
    already; `at` is a part's first window in the run."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, RUNS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, RUNS_AT_ONCE)):
            anchor, parent, copies, n = (batch.column(k).to_numpy() for k in range(4))
            raw = batch.column(4).to_pylist()
            if not raw:
                continue
            words = np.concatenate([np.frombuffer(w, np.uint64) for w in raw])
            size = n + WINDOW - 1
            first = np.cumsum(size) - size
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            least = np.sort(np.lib.stride_tricks.sliding_window_view(gram_hashes(words, ANCHOR), WINDOW - ANCHOR + 1)[first[of] + at], axis=1)
            key = np.zeros(len(of), np.uint64)
            for k in range(known, grams):
                key = mix(key ^ least[:, k])
            head = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(of) != 0)]))
            m = np.diff(np.concatenate([head, [len(of)]]))
            own, start = of[head], first[of[head]] + at[head]
            sums, inverse = _sums(words)
            run = mix((sums[start + m + WINDOW - 1] - sums[start]) * inverse[start] + m.astype(np.uint64))
            deal = mix(key[head] ^ mix(anchor[own].view(np.uint64)))
            pieces = [words[a : a + k + WINDOW - 1].tobytes() for a, k in zip(start.tolist(), m.tolist())]
            columns = [pa.array(parent[own]), pa.array(at[head].astype(np.int32)), pa.array(deal.view(np.int64)), pa.array(run.view(np.int64)), pa.array(m.astype(np.int32)), pa.array(copies[own]), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["parent", "at", "anchor", "run", "n", "copies", "words"])

    return split


def _masks(runs: DataFrame, dealt: int, anchor_runs: int, shards: int) -> DataFrame:
    """(run, mask) of the repeated windows of runs (anchor, run, copies, n, words), by the indexes of the shards.

    Runs of one anchor must meet in a shard. Where they are more than `anchor_runs`, they are split by further grams of their windows, in
    the order of the hashes (DEALT_BY), equal parts are made one with their copies, and the parts of one anchor and such grams
    must meet. Windows that have all grams in common are hardly ever different, so this ends.
    """
    most = anchor_runs if dealt + 1 < len(DEALT_BY) else 2**62
    hot = stored(runs.groupBy("anchor").count().where(F.col("count") > most).select("anchor"), "hot")
    last = hot.isEmpty()
    cold = runs if last else runs.join(hot, "anchor", "left_anti")
    cold = cold.select("anchor", "run", "copies", "n", "words").repartition(shards, "anchor")
    masks = stored(cold.mapInArrow(_search, "run long, mask long"), "masks")
    if last:
        return masks
    split = runs.join(hot, "anchor", "left_semi").select("anchor", "run", "copies", "n", "words")
    parts = stored(split.mapInArrow(_split(DEALT_BY[dealt], DEALT_BY[dealt + 1]), "parent long, at int, anchor long, run long, n int, copies long, words binary"), "parts")
    kinds = stored(parts.groupBy("anchor", "run", "n").agg(F.sum("copies").alias("copies"), F.first("words").alias("words")), "part-kinds")
    found = _masks(kinds, dealt + 1, anchor_runs, shards)
    spread = parts.select("parent", "at", "run").join(found, "run").groupBy(F.col("parent").alias("run")).agg(F.bit_or(F.expr("shiftleft(mask, at)")).alias("mask"))
    return masks.union(spread)


def repeated(docs: DataFrame, anchor_runs: int = ANCHOR_RUNS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, row2, spots: array of (start, mask)) of each row that has repeated windows; _row() names it, and bit i of a mask means the
    window from word start + i.

    Equal windows have equal anchors, so an anchor of one run has a repeated window only if that run holds a window twice, and
    anchors can be dealt to shards apart. Runs of equal words are one run with its copies. The runs of a shard are indexed once and
    streamed through that index, which tells how long a stretch that ends at each place is repeated. Shards are as many as the
    counted words ask for. An anchor with very many different runs, such as the edge of a passage that stands in many
    contexts, is dealt out anew by its windows' second gram, and so on (`_masks`), to the same kind of index.
    """
    spark = docs.sparkSession
    texts = docs.select(*_row(), "text")
    runs = stored(texts.mapInArrow(_runs, "anchor long, run long, row long, row2 long, start int, n int, twice boolean"), "runs")
    shared = stored(runs.groupBy("anchor").agg(F.count("*").alias("count"), F.max("twice").alias("twice")).where("count > 1 or twice").select("anchor"), "anchors")
    found = stored(runs.drop("twice").join(shared, "anchor"), "found")
    kinds = found.groupBy("anchor", "run", "n").agg(F.count("*").alias("copies"), F.min(F.struct("row", "row2", "start")).alias("first"))
    kinds = stored(kinds.select("anchor", "run", "n", "copies", F.col("first.row").alias("row"), F.col("first.row2").alias("row2"), F.col("first.start").alias("start")), "kinds")
    listed = kinds.groupBy("row", "row2").agg(F.collect_list(F.struct("start", "n", "anchor", "run", "copies")).alias("listed"))
    listed = stored(listed, "listed")
    total = kinds.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0]
    cut = texts.join(listed, ["row", "row2"]).select("text", "listed").mapInArrow(_cut, "anchor long, run long, copies long, n int, words binary")
    cut = stored(cut, "cut")
    shards = max(1, -(-int(total or 0) // shard_words), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spots = found.select("run", "row", "row2", "start").join(_masks(cut, 0, anchor_runs, shards), "run")
    return stored(spots.groupBy("row", "row2").agg(F.collect_set(F.struct("start", "mask")).alias("spots")), "spots")


def _kept(with_text: bool, with_spans: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()  # splits at space and \t to \r, as bytes do
                turn, total = np.zeros(len(words) + 1, np.int32), len(words)
                for spot in spots.as_py() or ():
                    begin = spot["start"] + np.flatnonzero((spot["mask"] >> np.arange(RUN)) & 1)
                    np.add.at(turn, begin, 1)
                    np.add.at(turn, begin + WINDOW, -1)
                gone = np.cumsum(turn[:-1]) > 0
                if gone.any():
                    words = list(compress(words, (~gone).tolist()))
                kept = b" ".join(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist() if with_spans else []
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, [{"start": a, "end": b} for a, b in edge]))
            columns = list(zip(*out)) or [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    return keep


def dedup_substrings(docs: DataFrame, with_text: bool = True, with_spans: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, spans) of every row of (doc_id, text).

    Removed is each word that lies in a window of WINDOW words whose sequence also starts at another place, of the same
    document or any other row; all copies go, the first too. `spans` are the removed word ranges. Words are
    `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by one space. Null and empty texts have no words. Rows
    that repeat each other are copies of each other.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spots = repeated(docs)
    rows = docs.select("doc_id", "text", *_row()).join(spots, ["row", "row2"], "left").select("doc_id", "text", "spots")
    return rows.mapInArrow(_kept(with_text, with_spans), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False, with_spans=False).drop("kept_text", "spans")


#: The same by the text of every window; a word goes if one of the 35 windows that cover it stands twice.
ORACLE = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
h as (select r, list_transform(range(1, len(words) - 33), lambda i: sha256(array_to_string(words[i:i + 34], ' '))) as h from w where len(words) >= 35),
k as (select r, unnest(range(1, len(h) + 1)) as p, unnest(h) as h from h),
spots as (select r, p from k where h in (select h from k group by h having count(*) > 1)),
gone as (select distinct r, p + j as p from spots cross join (select unnest(range(35)) as j)),
each as (select r, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w),
kept as (select r, count(*) as n, string_agg(word, ' ' order by p) as text from each anti join gone using (r, p) group by r)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (r)
"""

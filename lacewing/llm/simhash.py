"""SimHash near-duplicates: fingerprints, and a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, components, named, steps, stored, string_bytes, table, word_spans
from .lines import bounded

N_WORDS, SEED, MOST_BITS = 3, 42, 3
#: A group of fingerprints above this is dealt out once more; pairs that one traversal step may hold.
GROUP, AT_ONCE = 1000, 2_000_000


def fingerprints(col: pa.Array, n: int = N_WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if it is set in over half the XXH64 of the n-word shingles, repeats
    included. A-Z are lower-cased; fewer words are one shingle; no word gives 0."""
    data, off = string_bytes(col)
    data = FOLD[data]
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(len(col), np.uint64)
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    keep = black.copy()
    keep[1:] |= black[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    plain = data[keep]
    plain[~black[keep]] = 32
    raw, starts, ends = plain.tobytes(), place[starts], place[ends - 1] + 1
    count = np.diff(first)
    size = np.where(count > 0, np.maximum(1, count - n + 1), 0)
    head = np.repeat(first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    tail = np.minimum(head + n, np.repeat(first[1:], size)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[head].tolist(), ends[tail].tolist())), np.uint64, len(head))
    out, rows = np.zeros(len(col), np.uint64), np.flatnonzero(size)
    at = (np.cumsum(size) - size)[rows]
    for b in range(64):
        set_bits = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int64), at)
        out[rows] |= (2 * set_bits > size[rows]).astype(np.uint64) << np.uint64(b)
    return out


def trie_join(prints: np.ndarray, groups: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints in one group that differ in `most` bits or fewer.

    A group's sorted fingerprints are a binary trie whose nodes are ranges. Pairs of nodes go down together, a bit a
    step, all pairs of a level at once: like children keep the count of differing bits, unlike ones add to it, and a pair
    over the budget is pruned. `prints` are sorted within each of the (contiguous) `groups`.
    """
    cut = np.flatnonzero(np.diff(groups)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(groups)]])
    many = hi - lo > 1
    a0, a1 = lo[many], hi[many]
    b0, b1, errors = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[single], b0[single]
        close = np.bitwise_count(prints[x] ^ prints[y]) <= most
        found.append((x[close], y[close]))
        a0, a1, b0, b1, errors = (v[~single] for v in (a0, a1, b0, b1, errors))
        ones = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1)]
        parts.append(tuple(v[~same] for v in (am, a1, b0, bm, errors + 1)))
        a0, a1, b0, b1, errors = (np.concatenate(v) for v in zip(*parts))
        ok = (a1 > a0) & (b1 > b0) & (errors <= most) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, errors = (v[ok] for v in (a0, a1, b0, b1, errors))
    if len(a0):
        found.append((a0, b0))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def blocks_of(path: int) -> list[list[int]]:
    """The four blocks of bits that a group at `path` is dealt out by: those that its own path hasn't fixed, quartered."""
    left, digits = list(range(64)), []
    while path:
        digits.append(path & 7)
        path >>= 3
    for d in reversed(digits):
        fixed = [list(q) for q in np.array_split(left, 4)][d - 1]
        left = [b for b in left if b not in set(fixed)]
    return [list(q) for q in np.array_split(left, 4)]


def deal(rows: DataFrame) -> DataFrame:
    """Each (path, key, print, rep) four times, by the bits of each quarter of what is not fixed yet. Of two fingerprints
    that differ in three bits or fewer, one quarter at least is equal, at every depth."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, key, prints, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(path):
                at = np.flatnonzero(path == p)
                mine = prints[at].view(np.uint64)
                for d, bits in enumerate(blocks_of(int(p)), 1):
                    value = np.zeros(len(at), np.uint64)
                    for b in bits:
                        value = value << np.uint64(1) | (mine >> np.uint64(b)) & np.uint64(1)
                    joined = (key[at].view(np.uint64) << np.uint64(len(bits)) | value).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), int(p) * 8 + d, np.int64)), pa.array(joined), pa.array(prints[at]), pa.array(rep[at])], names=["path", "key", "print", "rep"])

    return rows.mapInArrow(split, "path long, key long, print long, rep long")


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) that connect all linked fingerprints of each group, a forest only. Rows come sorted by path, key, print."""

    def join(path: np.ndarray, key: np.ndarray, prints: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        turn = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(key) != 0)]))
        size = np.diff(np.concatenate([turn, [len(path)]]))
        group, load, lo = np.repeat(np.arange(len(turn)), size), np.cumsum(size.astype(np.int64) ** 2), 0
        while lo < len(turn):
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + AT_ONCE, "right")))
            a, b = int(turn[lo]), int(turn[hi] if hi < len(turn) else len(path))
            bits = prints[a:b].view(np.uint64)
            order = np.lexsort((bits, group[a:b]))
            x, y = trie_join(bits[order], group[a:b][order])
            label = forest(b - a, x, y)
            u, v = rep[a:b][order], rep[a:b][order][label]
            far = label != np.arange(b - a)
            yield pa.RecordBatch.from_arrays([pa.array(u[far]), pa.array(v[far])], names=["u", "v"])
            lo = hi

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(z) for z in zip(held, new)]
        if not len(held[0]):
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from join(*(v[:cut] for v in held))
            held = [v[cut:] for v in held]
    if held is not None and len(held[0]):
        yield from join(*held)


def near_links(prints: DataFrame, group: int = GROUP, deepest: int = 12) -> DataFrame:
    """(u, v) of reps whose fingerprints, joined up, differ in MOST_BITS or fewer, from distinct (print, rep).

    The fingerprints are dealt out by the value of each 16-bit quarter. A group above `group` is dealt out again by the
    quarters of its other bits, and so on, so no task gets an unbounded group; a trie joins each group left with itself.
    """
    rows = stored(deal(prints.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), "print", "rep")), "trie")
    ready = None
    for _ in range(deepest):
        hot = stored(rows.groupBy("path", "key").count().where(F.col("count") > group).select("path", "key"), "hot")
        if hot.isEmpty():
            break
        small = rows.join(hot, ["path", "key"], "left_anti")
        ready = small if ready is None else ready.union(small)
        rows = stored(deal(rows.join(hot, ["path", "key"], "left_semi").select("path", "key", "print", "rep")), "trie")
    ready = rows if ready is None else ready.union(rows)
    return ready.repartition("path", "key").sortWithinPartitions("path", "key", "print").mapInArrow(linked, "u long, v long")


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row, from its whole text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(fingerprints(step.column(1)).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, print long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Rows of one fingerprint are one node, named by its least doc_id; the trie sees distinct fingerprints only. Null
    and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id are one
    document with several texts. A row without doc_id gets the component of its fingerprint, null if no row of it has an id.
    """
    prints = stored(simhash(docs), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("rep")), "nodes")
    found = components(near_links(nodes.where("rep is not null")), "simhash")
    tied = stored(nodes.join(found, nodes.rep == found.node, "left").select("print", F.coalesce("component", "rep").alias("component_id")), "tied")
    return prints.join(tied, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component's least doc_id, with the columns of `docs`; of rows that repeat that id, one. Rows without
    doc_id can't be named and stay. Only rows whose id repeats are shuffled, where the ids that stay are few enough to be broadcast."""
    found = near_duplicates(docs)
    best = stored(found.where("doc_id = component_id").groupBy("doc_id").count(), "best")
    stay = lambda ids: docs.join(bounded(stored(best.where(ids).select("doc_id"), "stay")), "doc_id", "left_semi").select(*map(named, docs.columns))
    kept = stay("count = 1").union(docs.where("doc_id is null"))
    return kept if best.where("count > 1").isEmpty() else kept.union(stay("count > 1").dropDuplicates(["doc_id"]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

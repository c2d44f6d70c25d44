"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, WORD, gram_hashes, gram_rows, named, span_hashes, steps, stored, string_bytes, table, word_spans
from .lines import bounded

N_WORDS, THRESHOLD = 5, 0.8
#: Words of benchmark text that one broadcast may hold; a larger benchmark goes in blocks, each a pass over the documents.
BLOCK_WORDS = 2_000_000


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each row's first word."""
    data, off = string_bytes(col)
    data = FOLD[data]
    starts, ends, first = word_spans(data, off)
    return span_hashes(data, starts, ends), first


class Sketches:
    """The items of a block: all distinct shingles, and of each item the least few as a MinHash sketch.

    An item with q shingles of which a document holds at least threshold * q lacks at most
    floor((1 - threshold) * q), so of any one more than that the document holds one. Items are partitioned by size
    (powers of two), and a partition's sketch length follows from its largest size: no
    contained item is missed. Items of fewer words than a shingle are one shingle of all their words.
    """

    def __init__(self, ids: list, texts: list, n: int = N_WORDS, threshold: float = THRESHOLD):
        self.n, self.threshold = n, threshold
        words, first = _words(pa.array([t or "" for t in texts], pa.string()))
        self.ids, self.shingles, self.lengths = [], [], []
        keys: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(ids):
            own = words[first[i] : first[i + 1]]
            if not len(own):
                continue
            length = min(n, len(own))
            grams = np.unique(gram_hashes(own, length))
            upper = 1 << int(np.ceil(np.log2(len(grams)))) if len(grams) > 1 else 1
            k = min(len(grams), int((1 - threshold) * upper + 1e-9) + 1)
            keys.setdefault(length, []).extend((int(g), len(self.ids)) for g in grams[:k])
            self.ids.append(item)
            self.shingles.append(grams)
            self.lengths.append(length)
        self.index = {}
        for length, pairs in keys.items():
            pairs.sort()
            key = np.array([p[0] for p in pairs], np.uint64)
            near = np.zeros(1 << 20, bool)
            near[(key >> np.uint64(44)).astype(np.int64)] = True
            self.index[length] = key, np.array([p[1] for p in pairs]), near

    def search(self, col: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each row and item that reach the threshold."""
        words, first = _words(col)
        for length, (key, owner, near) in self.index.items():
            grams = gram_hashes(words, length)
            if not len(grams):
                continue
            at = np.flatnonzero(near[(grams >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(key, grams[at], "left"), np.searchsorted(key, grams[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            inside, row = gram_rows(first, length, len(grams))
            kept = inside[at]
            at, lo, hi = at[kept], lo[kept], hi[kept]
            found: dict[int, set[int]] = {}
            for r, a, b in zip(row[at].tolist(), lo.tolist(), hi.tolist()):
                found.setdefault(r, set()).update(owner[a:b].tolist())
            for r, items in found.items():
                own = np.unique(grams[first[r] : first[r + 1] - length + 1])
                for item in sorted(items):
                    want = self.shingles[item]
                    place = np.searchsorted(own, want)
                    shared = int((own[np.minimum(place, len(own) - 1)] == want).sum())
                    if shared >= self.threshold * len(want) - 1e-9:
                        yield r, item, shared


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every benchmark item whose distinct word shingles
    lie in a document to at least `threshold`.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Null and empty texts match nothing; rows that repeat a
    document or item give rows that repeat. The benchmark is broadcast in blocks of about `block_words` words,
    as many as its counted size asks for; documents are never shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = -(-int(total) // block_words)
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, n_shingles long, n_shared long, containment double"
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast(Sketches([r[0] for r in rows], [r[1] for r in rows], n, threshold))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            s = held.value
            for batch in batches:
                for step in steps(batch, "text"):
                    hits = list(s.search(step.column(1)))
                    ids = step.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    size = [len(s.shingles[h[1]]) for h in hits]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([s.ids[h[1]] for h in hits]).cast(held_type) if hits else pa.array([], held_type), pa.array(size, pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[2] / q for h, q in zip(hits, size)], pa.float64())], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        from pyspark.sql.pandas.types import to_arrow_type

        held_type = to_arrow_type(items.schema["item_id"].dataType)
        found = docs.select("doc_id", "text").mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item, with their columns. Rows of null doc_id stay; rows that share
    an id go together."""
    dirty = stored(contained_items(docs, benchmark, n, threshold).select("doc_id").distinct(), "dirty")
    return docs.join(bounded(dirty), "doc_id", "left_anti").select(*map(named, docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark
), bs as (
  select item_id, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) as s from b where len(w) > 0
), size as (
  select item_id, count(*) as n_shingles from bs group by item_id
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), ds as (
  select doc_id, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) as s from d where len(w) > 0
), shared as (
  select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id
)
select doc_id, item_id, n_shingles, n_shared, n_shared::double / n_shingles as containment from shared join size using (item_id)
where n_shared >= 0.8 * n_shingles - 1e-9
"""

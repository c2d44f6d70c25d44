"""Phrase collocation mining: phrases whose words stand together more often than their parts would by chance.

All phrases of 1 to `max_words` words become rows, level by level, and are hash-aggregated per language. A phrase of m words can
only reach the least count if both its parts of m - 1 words do, so a level gives a row only for phrases whose parts did: those
are marked in a bitmap of fixed size, in which a chance hit costs a row that the aggregation drops, and a mark is never missed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, gram_hashes, mix, named, numbered, small_or_shuffled, span_hashes, steps, stored, string_bytes, table, word_spans

MAX_WORDS, LEAST, TOP = 5, 100, 2000
NO_LANG = "und"
#: Bytes of text that are counted together before they become rows.
COUNTED_BYTES = 3 << 20
#: Bits a marked phrase gets in the bitmap, and the bits that the bitmap has at least and at most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: Bits of a row of Spark's bitmap functions.
BLOCK = 32_768
_PIECE, _BLANK = 10, 32
#: Each byte as a letter of a word (itself, A-Z lower-cased), a blank, or the end of a piece.
_KIND = FOLD.copy()
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _PIECE
COUNTS = "lang string, n int, phrase string, k long"


class Words:
    """The words of a batch: the code of each in `vocabulary`, its language, and how many follow it within its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, off = string_bytes(texts)
        data = _KIND[data]
        starts, ends, first = word_spans(data, off)
        size = ends - starts
        letters = data[(data != _BLANK) & (data != _PIECE)]
        words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        self.vocabulary, self.code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = langs.fill_null(NO_LANG).dictionary_encode()
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        breaks = np.cumsum(data == _PIECE)[starts] if len(starts) else starts
        new = np.ones(len(starts) + 1, bool)
        new[1:-1] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        edges = np.flatnonzero(new)
        self.left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(starts))  # words of the piece from here on

    def keys(self, n: int) -> np.ndarray:
        """A 64-bit number for the language and the n words from each word on; those that leave the piece are the caller's to drop."""
        data, off = string_bytes(self.vocabulary)
        lang_data, lang_off = string_bytes(self.langs)
        words = span_hashes(data, off[:-1], off[1:])[self.code]
        langs = span_hashes(lang_data, lang_off[:-1], lang_off[1:])[self.lang]
        grams = gram_hashes(words, n)
        return mix(grams ^ langs[: len(grams)])


def _grams(words: Words, at: np.ndarray, n: int) -> pa.RecordBatch:
    """Each different phrase of n words that begins at one of `at`, with the times it does."""
    codes, below = words.lang[at], len(words.langs)
    for j in range(n):
        if below * len(words.vocabulary) >= 1 << 62:  # else the numbers of phrases would pass 64 bits
            below, codes = len(at), np.unique(codes, return_inverse=True)[1]
        codes, below = codes * len(words.vocabulary) + words.code[at + j], below * len(words.vocabulary)
    _, one, times = np.unique(codes, return_index=True, return_counts=True)
    one = at[one]
    parts = [words.vocabulary.take(pa.array(words.code[one + j])) for j in range(n)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
    return pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.lang[one])).cast(pa.string()), pa.array(np.full(len(one), n), pa.int32()), phrase.cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "n", "phrase", "k"])


def _totals(words: Words) -> pa.RecordBatch:
    """The words of each language, as phrases of no words."""
    n = len(words.langs)
    times = np.bincount(words.lang, minlength=n)
    return pa.RecordBatch.from_arrays([words.langs.cast(pa.string()), pa.array(np.zeros(n), pa.int32()), pa.array([""] * n, pa.string()), pa.array(times, pa.int64())], names=["lang", "n", "phrase", "k"])


def marks(counted: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap, packed in bytes, of the keys of the phrases in `counted`, all of n words; and the number of its bits less one."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * counted.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, joined = batch.column(0), batch.column(1)
            keys = Words(words, joined).keys(n)
            first = np.arange(len(joined)) * n  # a phrase is a piece of n words
            yield pa.RecordBatch.from_arrays([pa.array((keys[first] & np.uint64(bits - 1)).astype(np.int64))], names=["bit"])

    block = F.expr(f"bit div {BLOCK}")
    rows = counted.select("lang", "phrase").mapInArrow(run, "bit long").groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % BLOCK).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)  # at most MOST_BITS, whatever the corpus
    for r in rows:
        out[r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out, bits - 1


def phrase_rows(docs: DataFrame, n: int, marked: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(lang, n, phrase, k): all phrases of n words of (lang, text), added up within some megabytes of text. Of n over 1 those only
    whose first and last n - 1 words are `marked`; with n of 1 the words of each language too, as n 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(marked)

    def counted(part: pa.RecordBatch) -> list[pa.RecordBatch]:
        words = Words(part.column(0), part.column(1))
        fits = words.left >= n
        if n == 1:
            return [_totals(words), _grams(words, np.flatnonzero(fits), n)]
        bitmap, mask = shipped.value
        bit = words.keys(n - 1) & np.uint64(mask)
        known = np.zeros(len(fits) + 1, bool)
        known[: len(bit)] = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
        return [_grams(words, np.flatnonzero(fits & known[:-1] & known[1:]), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", COUNTED_BYTES):
                yield from counted(part)
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, COUNTS)


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, a), stored: how often every phrase of 1 to `max_words` words stands in (lang, text), if `least` times or
    more; and the words of each language as n 0. The documents are read once a level."""
    levels, marked = [], None
    for n in range(1, max_words + 1):
        summed = phrase_rows(docs, n, marked).groupBy("lang", "n", "phrase").agg(F.sum("k").alias("a"))
        levels.append(stored(summed.where((F.col("a") >= least) | (F.col("n") == 0)), f"phrases-{n}"))
        marked = marks(levels[-1].where("n > 0"), n) if n < max_words else None
    return functools.reduce(DataFrame.unionByName, levels)


def _part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, n, score, k, l, r) of each phrase of several words, at its lowest-scoring cut. The products are
    decimals of 38 digits, which no corpus of under 10^16 words fills, and overflow is an error."""
    totals = small_or_shuffled(stored(counts.where("n = 0").select(F.col("lang").alias("of"), F.col("a").alias("total")), "totals"))
    parts = stored(counts.where("n > 0").select("lang", "phrase", "a"), "parts")
    cuts = counts.where("n > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("words"))
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(1, F.col("k")).alias("ahead"), _part(F.col("k") + 1, F.size("words")).alias("behind"))
    for name, part in (("l", "ahead"), ("r", "behind")):
        own = small_or_shuffled(parts).select(F.col("lang").alias("of"), F.col("phrase").alias("piece"), F.col("a").alias(name))
        cuts = cuts.join(own, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("piece"))).drop("of", "piece", part)
    cuts = cuts.join(totals, F.col("lang") == F.col("of")).drop("of")
    score = F.expr("cast(1000 * cast(a as decimal(16)) * cast(total as decimal(17)) as decimal(38)) div cast(cast(l as decimal(18)) * cast(r as decimal(18)) as decimal(38))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("total").alias("n"), F.first("words").alias("words"))
    return best.select("lang", "phrase", "words", "a", "n", "cut.*")


def without_parts(found: DataFrame) -> DataFrame:
    """`found` without the phrases that stand only within a longer one. If a longer phrase has as many occurrences, so has the one
    between them that is longer by one word, so extensions by one word decide."""
    size = F.size("words")
    wider = found.where(size > 2).select(F.col("lang").alias("of"), "a", F.explode(F.array(_part(1, size - 1), _part(2, size - 1))).alias("part"))
    wider = wider.groupBy("of", "part").agg(F.max("a").alias("most"))
    return found.join(wider, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (F.col("most") >= F.col("a")), "left_anti")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of 2 to `max_words` words that stand `least` times
    or more, by score, count and bytes.

    A null text has no words, a null language is `und`. Ties in score and count go by the phrase, so ranks are the same in every
    run; repeated rows count each time. Phrases don't cross punctuation or line ends. An empty table, or one without such a phrase,
    gives no rows; other columns take no part.
    """
    rows = docs.select(named(lang).cast("string").alias("lang"), named(text).cast("string").alias("text"))
    found = stored(scored(phrase_counts(rows, max_words, least)), "scored")
    ranked = numbered(without_parts(found).drop("words"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], "phrases")
    return ranked.where(F.col("rank") < top).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), starts as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0
), grams as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase from starts, range(1, 6) as t(size) where i + size - 1 <= len(w)
), counts as (
  select lang, size, phrase, count(*) as a from grams group by all having count(*) >= 100
), totals as (
  select lang, sum(len(w))::bigint as n from words group by lang
), candidates as (
  select *, string_split(phrase, ' ') as w from counts where size > 1
), cuts as (
  select lang, phrase, a, size, k, array_to_string(w[1:k], ' ') as ahead, array_to_string(w[k + 1:], ' ') as behind from candidates, range(1, 5) as t(k) where k < size
), scored as (
  select c.lang, c.phrase, c.a, c.size, c.k, x.a as l, y.a as r, n, (1000::hugeint * c.a * n // (x.a::hugeint * y.a))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = ahead join counts y on y.lang = c.lang and y.phrase = behind join totals t on t.lang = c.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), kept as (
  select * from best b where not exists (
    select 1 from candidates o where o.lang = b.lang and o.size > b.size and o.a >= b.a and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

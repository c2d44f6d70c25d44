"""Pieces that several operators share: shared storage, word tables, components."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words, as a regular expression class: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on; a longer document is one step of its own.
STEP_BYTES = 2 << 20
#: A table of up to so many bytes is broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a session on one machine (tests) may do without:
    a temporary folder takes its place there. On a cluster a missing setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def spare(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """The stored table `df` with `rank` (from 0, in the order of `order` among rows equal in `groups`, null being equal to null)
    and `members`, their number. Rows are range-sorted by group and order, so that a hot group spreads over many tasks; one row
    a group and partition says how many came before. Rows equal in all of `order` are numbered as they lie."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(named, groups), *order]
    place, part = spare(df, "place"), spare(df, "part")
    rows = stored(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id()), f"{name}-sorted")
    keys = {g: f"{place}_{i}" for i, g in enumerate(groups)}
    counts = rows.groupBy(*[named(g).alias(k) for g, k in keys.items()], F.shiftright(named(place), 33).alias(part)).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys.values())
    before = F.coalesce(F.sum("n").over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select(*keys.values(), F.col(part).alias(f"{part}_of"), (before - F.col("first")).alias(f"{place}_shift"), F.sum("n").over(whole).alias("members")), f"{name}-starts")
    match = F.shiftright(named(place), 33) == F.col(f"{part}_of")
    for g, k in keys.items():
        match &= named(g).eqNullSafe(F.col(k))
    return rows.join(small_or_shuffled(starts), match).select(*map(named, df.columns), (named(place) + F.col(f"{place}_shift")).alias("rank"), "members")


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The stored table `df` of strings and numbers, to be broadcast if they take at most `most` bytes in all; else Spark shuffles
    as it sees fit."""
    width = sum((F.coalesce(F.octet_length(named(c)), F.lit(0)) if kind in ("string", "binary") else F.lit(8)) + 16 for c, kind in df.dtypes)
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def remainder(column: str, of: int) -> Column:
    """crc32 of the id's decimal text, modulo `of`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- words of Arrow string columns, without a Python loop over words ---------------------------------

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of a word that are hashed in numpy, eight at a time; a longer word is hashed by itself.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and the n+1 offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes each, never less than a row."""
    if not batch.num_rows:
        return
    _, off = string_bytes(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (n+1 numbers)."""
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = black.copy()
    start[1:] &= ~black[:-1]
    inner = off[:-1][np.diff(off) > 0]
    start[inner] = black[inner]
    end = black.copy()
    end[:-1] &= ~black[1:]
    last = off[1:][np.diff(off) > 0] - 1
    end[last] = black[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes after eight, each mixed into what came before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(todo):
        cut = (8 * np.maximum(0, 8 - (size[todo] - at))).astype(np.uint64)
        out[todo] = mix((out[todo] ^ (eight[starts[todo] + at] << cut >> cut)) + np.uint64(0xD6E8FEB86659FD93))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words; those that cross a row's end are the caller's to drop."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, np.uint64(n))
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + count]
    return mix(out)


def gram_rows(first: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of `count` n-grams lie within one row, and that row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    return np.arange(count) + n <= first[row + 1], row


# --- connected components ----------------------------------------------------------------------------


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node in `edges` (u, v: long): component is the smallest node reachable.

    Each round takes the least label among a node's neighbours, hands it to the node that was its label too, so that
    roots are hooked, and then follows that label's own label. A component needs about as many rounds as its diameter's logarithm,
    and rounds go on until no label changes. Labels and links are stored tables, so a hot node's rows meet in plain
    sort-merge joins, which Spark splits; every reduction is a partial minimum first. Null ends and self-links are ignored.
    """
    clean = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    both = stored(clean.union(clean.select("v", "u")).distinct().toDF("u", "v"), f"{name}-links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), f"{name}-labels")
    total = None
    while True:
        heard = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        near = heard.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        near = stored(near, f"{name}-near")
        hooked = near.select("node", "label").union(near.where("label < old").select("old", "label"))
        least = stored(hooked.groupBy("node").agg(F.min("label").alias("label")), f"{name}-hooked")
        up = least.select(F.col("node").alias("at"), F.col("label").alias("above"))
        new = stored(least.join(up, least.label == up.at).select("node", F.col("above").alias("label")), f"{name}-labels")
        discard(labels, near, least)
        labels = new
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:
            break
        total = now
    discard(both)
    return labels.select("node", F.col("label").alias("component"))

"""WARC archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import bisect
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, table
from .lines import bounded

#: Payload bytes of a shard, compressed bytes after which a file is closed. No corpus has more shards than MOST_SHARDS, which bounds
#: the table of their first keys; shards of a larger one hold more.
SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 32 << 20, 16 << 20, 20_000
#: What a record weighs beside its payload when shards are measured out.
HEAD_BYTES = 600
#: Equal payloads of at least so many bytes are written once; the others revisit.
REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def compress(record: bytes) -> bytes:
    """A gzip member without time or name, so equal records are equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record, all headers made anew. The page's number is in headers of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))))
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1_hex() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def shard_bounds(rows: DataFrame, total: int, count: int, shard_bytes: int) -> list[tuple[str, int]]:
    """The first key (url, page) of each shard but the first, in order.

    The keys alone are sorted, over the cluster, with the bytes that stand before each: those of the partitions before and a running sum
    within its own. A shard begins where those pass a multiple of the shard's bytes, so bounds don't hang on partitions.
    """
    shards = min(MOST_SHARDS, -(-(total + HEAD_BYTES * count) // shard_bytes))
    if shards < 2:
        return []
    each = -(-(total + HEAD_BYTES * count) // shards)
    keys = rows.select(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("page_id", F.lit(-1)).alias("page"), (F.coalesce(F.octet_length("html"), F.lit(0)) + HEAD_BYTES).cast("long").alias("bytes"))
    keys = stored(keys.repartitionByRange("url", "page").withColumn("part", F.spark_partition_id()), "keys")
    parts = keys.groupBy("part").agg(F.sum("bytes").alias("held"))
    parts = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("part").orderBy("url", "page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keys.withColumn("before", before).join(F.broadcast(parts), "part")
    first = placed.groupBy(F.floor((F.col("offset") + F.col("before")) / each).alias("shard")).agg(F.min(F.struct("url", "page")).alias("k"))
    return sorted({(r.url, r.page) for r in first.where("shard > 0").select("k.*").collect()})


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes `pages` (page_id, url, html) as gzipped WARC files under `folder` and returns the manifest: shard, part, file,
    records, bytes.

    Records are sorted by url and page_id. Shards are ranges of that order of about `shard_bytes` each, measured out
    exactly, so the same pages give the same files whatever the cluster does, and a task has one shard. A task writes its files under temporary
    names; only those that a finished task reports are renamed, and the manifest is written last, so a lost executor or a second
    attempt leaves nothing half done. Null html is an empty payload; null url has no target header. Of equal payloads
    the largest page_id is the response (null ids never, unless there is no other); rows that repeat it are responses too.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    sums = stored(rows.select("page_id", size.alias("payload_bytes"), sha1_hex().alias("same")), "digests")
    total = sums.agg(F.sum("payload_bytes"), F.count("*")).first()
    equal = sums.where(F.col("payload_bytes") >= revisit_bytes).groupBy("same").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    equal = stored(equal.where("n > 1 and response is not null").select("same", "response"), "equal")
    bounds = shard_bounds(rows, int(total[0] or 0), int(total[1]), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, k) for k in zip(url, page)], dtype="int32")

    dealt = rows.select("page_id", "url", "html", sha1_hex().alias("digest"), shard_of(F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(-1))).alias("shard"))
    dealt = dealt.join(bounded(equal), dealt.digest == equal.same, "left").drop("same")
    ordered = dealt.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(-1)), "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{base}/_temporary", recursive=True)
        context = TaskContext.get()
        attempt, out, at, done = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}", None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                done.append(at)

        for batch in batches:
            for page, url, html, sha1, shard, response in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[0] != shard or at[4] >= file_bytes:
                    close()
                    part = at[1] + 1 if at is not None and at[0] == shard else 0
                    name = f"shard-{shard:05d}-{part:04d}.warc.gz"
                    at = [shard, part, name, 0, 0, f"_temporary/{name}.{attempt}"]
                    out = store.open_output_stream(f"{base}/{at[5]}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = compress(record(page, url, (html or "").encode(), digest, response, response is not None and response != page))
                out.write(raw)
                at[3] += 1
                at[4] += len(raw)
        close()
        columns = list(zip(*done)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.string())], names=["shard", "part", "file", "records", "bytes", "written"])

    written = stored(ordered.mapInArrow(write, "shard int, part int, file string, records long, bytes long, written string"), "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                if store.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{temporary}", f"{base}/{name}")
                elif store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch.drop_columns(["written"])

    manifest = written.mapInArrow(rename, "shard int, part int, file string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def records(content: bytes, chunk: int = 64 << 10) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a file; what follows a member is at most a chunk, never the rest of the file."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            piece = view[at : at + chunk]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives that the manifest in
    `folder` lists; other files there are not read.

    Digests are computed again, and one that differs from its header is an error. A revisit has null html; its size is
    that in the HTTP header and its digest that of the payload it refers to.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as file:
                    content = file.read()
                if len(content) != size:
                    raise ValueError(f"{name} has {len(content)} bytes, its manifest says {size}")
                rows: list[tuple] = []
                for headers, block in records(content):
                    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and (digest != base32_sha1(payload) or size != len(payload)):
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} differs")
                    page, response, url = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id"), headers.get("WARC-Target-URI")
                    rows.append((page and int(page), url, payload.decode() if kind == "response" else None, size, digest, kind, response and int(response)))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.parquet(f"{folder}/manifest").select("file", "bytes")
    return files.repartition(max(1, min(MOST_SHARDS, files.count()))).mapInArrow(parse, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("url", "html")


ORACLE = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1) for i in range(32)], '') as payload_digest from p
), g as (
  select *, max(page_id) over (partition by payload_digest) as top from d
)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to from g
"""

"""Tables that change together: numbered versions, each made by a record that can be created only once.

A version's record names the folders of every table's rows, so whoever holds a version reads all tables as of one moment. A writer
reads the last version, writes its rows to folders of its own, and creates the record of the next number. If another writer has
created that number, it reads again and tries again with what it then finds; what it wrote before is named by no record.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered, stored


class Refused(ValueError):
    """A change that the stored rows don't allow; nothing of it is stored."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """Rows to append by table, rows to put in a table's place, the last id given out by counter, and what to tell the caller.
    A change without rows makes no version."""

    appended: dict[str, DataFrame] = field(default_factory=dict)
    replaced: dict[str, DataFrame] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)
    result: object = None


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with all of `text`, or changes nothing and gives False if there is one. The text is first written under a
    name of its own; taking the final name is one step of the file system, which fails for all writers but one."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    p, fs = _file_system(spark, path)
    if fs.getScheme() == "file":  # whose rename would replace a file, whereas a link doesn't
        name, own = (unquote(urlparse(x).path) for x in (path, temporary))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    jvm = spark._jvm
    t = jvm.org.apache.hadoop.fs.Path(temporary)
    out = fs.create(t, False)
    out.write(bytearray(text.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(t, p, options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    finally:
        fs.delete(t, False)


class Ledger:
    """The tables in `folder`. Those named in `schemas` (name -> DDL) may be empty; of others the files have the schema."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str] | None = None):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas or {}

    def _record(self, number: int) -> str:
        return f"{self.folder}/versions/{number:020d}.json"

    def numbers(self) -> list[int]:
        p, fs = _file_system(self.spark, f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, number: int) -> Version:
        """The version of that number; 0 is the empty one."""
        return Version(**json.loads(self.spark.read.text(self._record(number), wholetext=True).first()[0])) if number else Version()

    def head(self) -> Version:
        return self.at(max(self.numbers(), default=0))

    def read(self, name: str, version: Version) -> DataFrame:
        """A table as of `version`, whatever has been committed since."""
        folders = [f"{self.folder}/{f}" for f in version.tables.get(name, [])]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        return reader.parquet(*folders)

    def commit(self, change: Callable[[Version], Change], tries: int = 50) -> tuple[Version, object]:
        """Makes the next version from what `change` says about the last one, and gives it with the change's result. `change` runs
        again for each version that another writer makes meanwhile, so what it checked holds of the version it follows."""
        for attempt in range(tries):
            seen = self.head()
            wanted = change(seen)
            if not wanted.appended and not wanted.replaced:
                return seen, wanted.result
            tables = dict(seen.tables)
            for kind, frames in (("appended", wanted.appended), ("replaced", wanted.replaced)):
                for name, df in frames.items():
                    place = f"rows/{name}-{uuid.uuid4().hex}"
                    if name in self.schemas:
                        df = df.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schemas[name]).schema])
                    df.write.parquet(f"{self.folder}/{place}")
                    tables[name] = [*(tables.get(name, []) if kind == "appended" else []), place]
            made = Version(seen.number + 1, tables, seen.last_ids | wanted.last_ids)
            if create_once(self.spark, self._record(made.number), json.dumps(made.__dict__)):
                return made, wanted.result
            time.sleep(random.uniform(0, 0.05 * 2 ** min(attempt, 6)))
        raise TimeoutError(f"{tries} versions were made by other writers meanwhile")

    def forget(self, keep: int = 1) -> list[str]:
        """Takes away all versions but the last `keep`, and then the folders that no version names any more, which it gives. For a
        clean-up while none is writing or reads an older version; if it stops half way, the rest is left for the next."""
        for number in self.numbers()[:-keep]:
            p, fs = _file_system(self.spark, self._record(number))
            fs.delete(p, False)
        gone = self.unnamed()
        for folder in gone:
            p, fs = _file_system(self.spark, f"{self.folder}/{folder}")
            fs.delete(p, True)
        return gone

    def unnamed(self) -> list[str]:
        """Folders of rows that no version names: what writers left that lost or stopped. For a clean-up while none is writing."""
        p, fs = _file_system(self.spark, f"{self.folder}/rows")
        named = {f for n in self.numbers() for folders in self.at(n).tables.values() for f in folders}
        return sorted(x for x in (f"rows/{s.getPath().getName()}" for s in (fs.listStatus(p) if fs.exists(p) else [])) if x not in named)


# --- snapshots of observations, and the attempts that collect them -----------------------------------

SNAPSHOTS = "snapshot_id long, source string, observed_at timestamp_ntz, digest string"
OBSERVATIONS = "snapshot_id long, product_id long, price double"
ATTEMPTS = "attempt_id long, key string, outcome string, at timestamp_ntz, snapshot_id long, products long, error string"
TABLES = {"snapshots": SNAPSHOTS, "observations": OBSERVATIONS, "attempts": ATTEMPTS}
KEY = ["source", "observed_at"]


def _refuse_any(rows: DataFrame, why: str) -> None:
    found = rows.limit(5).collect()
    if found:
        raise Refused(f"{why}: {'; '.join(', '.join(map(str, r)) for r in found)}")


def _states(ledger: Ledger, seen: Version) -> DataFrame:
    """The last transition of each attempt: pending is the first, and there is one more at most."""
    rows = ledger.read("attempts", seen)
    ends = F.when(F.col("outcome") == "pending", 0).otherwise(1)
    return rows.groupBy("attempt_id").agg(F.max_by(F.struct("key", "outcome", "at", "snapshot_id", "products", "error"), ends).alias("last")).select("attempt_id", "last.*")


def _pending(ledger: Ledger, seen: Version, ids: DataFrame) -> DataFrame:
    """(attempt_id, key) of `ids`, each of which must be pending, and be there once."""
    _refuse_any(ids.groupBy("attempt_id").count().where("count > 1").select("attempt_id"), "finished twice at once")
    known = ids.join(_states(ledger, seen).select("attempt_id", "key", "outcome"), "attempt_id", "left")
    _refuse_any(known.where(F.coalesce(F.col("outcome"), F.lit("")) != "pending").select("attempt_id", "outcome"), "not pending")
    return known.select("attempt_id", "key")


def import_snapshots(ledger: Ledger, snapshots: DataFrame, observations: DataFrame, at: Column | None = None) -> tuple[Version, dict[str, int]]:
    """Stores the new snapshots of a batch (source, observed_at, digest[, attempt_id]) with their observations (source, observed_at,
    product_id, price) and ends their attempts, all in one version. Gives that version and the counts.

    A snapshot that is stored already, or stands twice in the batch, with the same digest counts once; with another digest, without
    observations, or with an attempt that isn't pending, the whole batch is refused, and so is a collected snapshot that is
    stored already. Ids follow on the last one given out, by time and source, so a higher id is a later version or the same.
    """
    collected = "attempt_id" in snapshots.columns
    one = snapshots.groupBy(*KEY).agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.max("attempt_id").alias("attempt_id") if collected else F.lit(None).cast("long").alias("attempt_id"))

    def change(seen: Version) -> Change:
        known = ledger.read("snapshots", seen).select(*KEY, F.col("digest").alias("known"))
        action = F.when((F.col("digest") != F.col("other")) | (F.col("known") != F.col("digest")), "conflict").when(F.col("known").isNull(), "new")
        tagged = stored(one.join(known, KEY, "left").withColumn("action", action.when(F.col("attempt_id").isNotNull(), "collected again").otherwise("unchanged")), "tagged")
        for wrong in ("conflict", "collected again"):
            _refuse_any(tagged.where(F.col("action") == wrong).select(*KEY), wrong)
        new = tagged.where("action = 'new'")
        _refuse_any(new.join(observations, KEY, "left_anti").select(*KEY), "no observations")
        counts = {r.action: r["count"] for r in tagged.groupBy("action").count().collect()}
        told = {"inserted": counts.get("new", 0), "unchanged": counts.get("unchanged", 0)}
        if not told["inserted"]:
            return Change(result=told)
        last = seen.last_ids.get("snapshots", 0)
        ids = stored(numbered(new, [F.col("observed_at"), F.col("source")], "new").withColumn("snapshot_id", F.col("rank") + last + 1), "snapshot-ids")
        rows = observations.dropDuplicates([*KEY, "product_id"]).join(ids.select(*KEY, "snapshot_id"), KEY)
        out = {"snapshots": ids, "observations": rows}
        ends = ids.where("attempt_id is not null")
        if collected and not ends.isEmpty():
            size = rows.groupBy("snapshot_id").agg(F.count("*").alias("products"))
            done = _pending(ledger, seen, ends.select("attempt_id")).join(ends.select("attempt_id", "snapshot_id"), "attempt_id").join(size, "snapshot_id")
            out["attempts"] = done.select("attempt_id", "key", F.lit("stored").alias("outcome"), at.alias("at"), "snapshot_id", "products", F.lit(None).cast("string").alias("error"))
        return Change(out, last_ids={"snapshots": last + told["inserted"]}, result=told)

    return ledger.commit(change)


def begin_attempts(ledger: Ledger, keys: DataFrame, at: Column) -> tuple[Version, int]:
    """A pending attempt for each row of `keys` (key), numbered by key after the last one. Gives the version and the first id."""

    def change(seen: Version) -> Change:
        last = seen.last_ids.get("attempts", 0)
        rows = stored(numbered(keys, [F.col("key")], "begun"), "begun")
        n = rows.count()
        begun = rows.select((F.col("rank") + last + 1).alias("attempt_id"), "key", F.lit("pending").alias("outcome"), at.alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in (("snapshot_id", "long"), ("products", "long"), ("error", "string"))])
        return Change({"attempts": begun} if n else {}, last_ids={"attempts": last + n}, result=last + 1)

    return ledger.commit(change)


def finish_attempts(ledger: Ledger, ends: DataFrame, at: Column) -> tuple[Version, int]:
    """Ends attempts as (attempt_id, outcome, error) says: `failed`, or `empty` with no products. All must be pending, or none ends."""

    def change(seen: Version) -> Change:
        _refuse_any(ends.where(~F.col("outcome").isin("failed", "empty") | F.col("outcome").isNull()).select("attempt_id", "outcome"), "no such outcome")
        rows = _pending(ledger, seen, ends.select("attempt_id")).join(ends, "attempt_id")
        n = ends.count()
        done = rows.select("attempt_id", "key", "outcome", at.alias("at"), F.lit(None).cast("long").alias("snapshot_id"), F.when(F.col("outcome") == "empty", F.lit(0)).cast("long").alias("products"), F.when(F.col("outcome") == "failed", F.col("error")).alias("error"))
        return Change({"attempts": done} if n else {}, result=n)

    return ledger.commit(change)


def latest_attempts(ledger: Ledger, seen: Version) -> DataFrame:
    """The state of each key's attempt of the highest id."""
    rest = ["attempt_id", "outcome", "at", "snapshot_id", "products", "error"]
    return _states(ledger, seen).groupBy("key").agg(F.max_by(F.struct(*rest), "attempt_id").alias("last")).select("key", "last.*")


def current_prices(ledger: Ledger, seen: Version) -> DataFrame:
    """Each product's observation of the latest time, then the highest snapshot, as of one version."""
    rows = ledger.read("observations", seen).join(ledger.read("snapshots", seen), "snapshot_id")
    return rows.groupBy("source", "product_id").agg(F.max_by(F.struct("price", "observed_at", "snapshot_id"), F.struct("observed_at", "snapshot_id")).alias("last")).select("source", "product_id", "last.*")

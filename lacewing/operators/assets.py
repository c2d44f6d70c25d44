"""A content-addressed store of artworks: index and contents in one ledger, marked and swept by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Change, Ledger, Refused, Version
from .numbering import stored

TABLES = {"artworks": "cid long, ciid long, image string, sha256 string", "contents": "sha256 string, content binary"}


def store(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(spark, folder, TABLES)


def extension(content: Column) -> Column:
    """png or jpg by the first bytes; null for anything else."""
    first = F.hex(F.substring(content, 1, 8))
    return F.when(first == "89504E470D0A1A0A", "png").when(F.startswith(first, F.lit("FFD8FF")), "jpg")


def upsert(ledger: Ledger, entries: DataFrame) -> tuple[Version, dict[str, int]]:
    """Puts the artworks of `entries` (cid, ciid, content) in the place of all that the index has of their cards, in one version, and adds
    the contents that aren't there yet. Gives the version and how many cards, artworks and contents were put in.

    An image's name holds card, artwork and the first of its digest. A content that is no image, a null id, or one artwork with two
    contents refuses the whole batch. A crash before the version leaves the old index and some contents that `sweep` takes away.
    """
    digest = F.sha2("content", 256)
    name = F.format_string("images/%d_%d_%s.%s", F.col("cid"), F.col("ciid"), F.substring("sha256", 1, 12), extension(F.col("content")))
    rows = stored(entries.select("cid", "ciid", "content", digest.alias("sha256")).withColumn("image", F.when(extension(F.col("content")).isNotNull(), name)), "entries")
    bad = rows.groupBy("cid", "ciid").agg(F.countDistinct("sha256").alias("n"), F.count("image").alias("good"), F.count("*").alias("all")).where("n <> 1 or good <> all or cid is null or ciid is null")

    def change(seen: Version) -> Change:
        if found := bad.limit(5).collect():
            raise Refused("; ".join(f"{r.cid}, {r.ciid}" for r in found))
        new = rows.select("cid", "ciid", "image", "sha256").distinct()
        kept = ledger.read("artworks", seen).join(new.select("cid").distinct(), "cid", "left_anti")
        known = ledger.read("contents", seen).select("sha256")
        contents = rows.groupBy("sha256").agg(F.first("content").alias("content")).join(known, "sha256", "left_anti")
        counts = {"cards": new.select("cid").distinct().count(), "artworks": new.count(), "contents": contents.count()}
        if not counts["cards"]:
            return Change(result=counts)
        return Change({"contents": contents} if counts["contents"] else {}, {"artworks": kept.unionByName(new)}, result=counts)

    return ledger.commit(change)


def audit(ledger: Ledger, seen: Version) -> DataFrame:
    """(sha256, state, artworks) of every content that is named or there: `missing`, `damaged` (its bytes have another digest), `garbage`
    (no artwork names it) or `live`."""
    named = ledger.read("artworks", seen).groupBy("sha256").agg(F.count("*").alias("artworks"))
    there = ledger.read("contents", seen).select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("sound")).groupBy("sha256").agg(F.every("sound").alias("sound"))
    state = F.when(F.col("sound").isNull(), "missing").when(~F.col("sound"), "damaged").when(F.col("artworks").isNull(), "garbage").otherwise("live")
    return named.join(there, "sha256", "full").select("sha256", state.alias("state"), F.coalesce("artworks", F.lit(0)).alias("artworks"))


def sweep(ledger: Ledger) -> tuple[Version, int]:
    """A version without the contents that no artwork names, and how many those were. Older versions still read theirs until
    `Ledger.forget`. Contents that another writer's version names meanwhile stay, since the sweep then begins anew."""

    def change(seen: Version) -> Change:
        contents = ledger.read("contents", seen)
        live = contents.join(ledger.read("artworks", seen).select("sha256").distinct(), "sha256", "left_semi")
        gone = contents.count() - live.count()
        return Change(replaced={"contents": live}, result=gone) if gone else Change(result=0)

    return ledger.commit(change)

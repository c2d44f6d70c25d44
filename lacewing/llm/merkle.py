"""Merkle dataset manifest: every row a leaf, a tree of fixed fan-out over each group, and a tree over the groups.

A parent is stored as its preimage, the digests of its children one after another. A leaf that joins the preimages of its
ancestors has all that a proof needs: what is left of a preimage without the own slot of 64 characters are the siblings, and
a preimage with another digest in that slot hashes to the changed parent.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, named, numbered, remainder, stored, table

FAN_OUT = 8
#: Characters of a digest in hexadecimal.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,preimage:string>>"


def field(value: Column) -> Column:
    """A value so written that different rows of values read differently: its bytes, a colon and the value, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _beside(at: Column, instead: Column) -> Column:
    """A preimage with something else in the own slot."""
    before = at["slot"] * DIGEST
    return F.concat(F.substring(at["preimage"], F.lit(1), before), instead, F.substring(at["preimage"], before + DIGEST + 1, F.length(at["preimage"])))


def siblings(path: Column) -> Column:
    """The digests beside the own ones, from the leaf's run up to the root's, in one string."""
    return F.array_join(F.transform(path, lambda at: _beside(at, F.lit(""))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from `leaf` and the siblings in `path`."""
    return F.aggregate(path, leaf, lambda digest, at: F.sha2(_beside(at, digest), 256))


def _run(fan_out: int) -> Column:
    return F.expr(f"idx div {fan_out}")


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """(by, idx, digest, members) of a level -> the same and the preimage of the next, for groups of several nodes. A run is at
    most `fan_out` rows, whatever the group."""
    runs = nodes.where("members > 1").groupBy("by", _run(fan_out).alias("idx"))
    made = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.max("members").alias("members"))
    made = made.select("by", "idx", F.array_join(F.col("run.digest"), "").alias("preimage"), F.expr(f"(members + {fan_out - 1}) div {fan_out}").alias("members"))
    return made.withColumn("digest", F.sha2("preimage", 256))


def _levels(leaves: DataFrame, fan_out: int, name: str) -> list[DataFrame]:
    """The levels over (by, idx, digest, members), stored, the lowest first: as many as the largest group needs."""
    levels, most = [], leaves.agg(F.max("members")).first()[0] or 0
    while most > 1:
        levels.append(stored(_parents(levels[-1] if levels else leaves, fan_out), f"{name}-{len(levels) + 1}"))
        most = -(-most // fan_out)
    return levels


def _tops(nodes: list[DataFrame]) -> DataFrame:
    """(by, digest) of the node that remains of each group."""
    return functools.reduce(DataFrame.unionByName, [n.where("members = 1").select("by", "digest") for n in nodes])


def _descend(leaves: DataFrame, levels: list[DataFrame], last: Callable[[DataFrame], DataFrame], fan_out: int) -> DataFrame:
    """`leaves` with path and subroot. `last` gives both to the node that remains of a group; every other takes its parent's and
    puts that parent's preimage in front. From the top down, so that a level is an eighth of the one below."""
    above = None
    for nodes in [*reversed(levels), leaves]:
        whole = last(nodes.where("members = 1"))
        if above is not None:
            up = above.select(F.col("by").alias("of"), F.col("idx").alias("run"), F.col("preimage").alias("siblings"), F.col("path").alias("rest"), "subroot")
            lower = nodes.where("members > 1").join(up, F.col("by").eqNullSafe(F.col("of")) & (_run(fan_out) == F.col("run")))
            step = F.struct((F.col("idx") % fan_out).cast("int").alias("slot"), F.col("siblings").alias("preimage"))
            whole = whole.unionByName(lower.withColumn("path", F.concat(F.array(step), "rest")).drop("of", "run", "siblings", "rest"))
        above = whole
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", key: str = "doc_id", fan_out: int = FAN_OUT, **carried: Column) -> DataFrame:
    """(key, leaf, subroot, root, path, and what is `carried`) of every row of `docs`.

    Leaves ascend by `key` within the rows equal in `by`, null first; rows of one key ascend by leaf, and equal rows have equal
    leaves in either order, each its own place. Every `fan_out` consecutive nodes become one, the last run of a level as well,
    until one node remains; the subroots, ordered by `by` with null first, become the root in the same way. `path` has from the
    leaf's run upwards the preimage of each parent and the own slot in it, and is empty where a lone leaf is the root. Null
    counts as `-` in a leaf. An empty table gives no rows; other columns of `docs`, whatever their names, take no part.
    """
    rows = docs.select(named(key).alias("key"), named(by).alias("by"), leaf_digest(*map(named, fields)).alias("digest"), *[c.alias(f"carried_{n}") for n, c in carried.items()])
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, ["by"], [F.col("key"), F.col("digest"), F.col("row")], "leaves").drop("row").withColumnRenamed("rank", "idx")
    levels = _levels(leaves, fan_out, "level")

    tops = stored(_tops([leaves, *levels]), "subroots")
    groups = stored(numbered(tops, [], [F.col("by")], "groups").select(F.lit("").alias("by"), F.col("rank").alias("idx"), "digest", "members", F.col("by").alias("group")), "groups")
    above = _levels(groups, fan_out, "top")
    one = _tops([groups, *above]).first()
    ends = _descend(groups, above, lambda n: n.withColumns({"path": F.expr(f"cast(array() as {PATH})"), "subroot": F.lit("")}), fan_out)
    ends = stored(ends.select(F.col("group").alias("of"), "path", F.col("digest").alias("subroot")), "ends")

    placed = _descend(leaves, levels, lambda n: n.join(ends, F.col("by").eqNullSafe(F.col("of"))).drop("of"), fan_out)
    return placed.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(one.digest if one else None).cast("string").alias("root"), "path", *[F.col(f"carried_{n}").alias(n) for n in carried])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = leaf_digest(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(docs, tampered=F.when(remainder("doc_id", 3) == 0, lowered))
    again = folded(F.col("path"), F.coalesce("tampered", "leaf"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _written(column: str) -> str:
    return f"coalesce(strlen({column}::varchar)::varchar || ':' || {column}::varchar, '-')"


_AHEAD = "".join(f"{_written(c)} || " for c in FIELDS if c != "text")
_CRC32 = (
    "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), "
    "lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::bigint), 4294967295)"
)
ORACLE = f"""
with recursive docs as (
  select row_number() over () as id, doc_id, lang, sha256({_AHEAD}{_written("text")}) as leaf,
    case when {_CRC32} % 3 = 0 then sha256({_AHEAD}{_written("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as tampered
  from documents
), leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from docs
), nodes(lang, level, idx, digest, n) as (
  select lang, 0, pos, leaf, n from leaves
  union all
  select lang, level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 7) // 8 from nodes where n > 1 group by lang, level, idx // 8
), subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), upper(level, idx, digest, n) as (
  select 0, pos, digest, n from subroots
  union all
  select level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 7) // 8 from upper where n > 1 group by level, idx // 8
), runs as (
  select lang, level, idx // 8 as idx, string_agg(digest, '' order by idx) as preimage from nodes where n > 1 group by lang, level, idx // 8
), upper_runs as (
  select level, idx // 8 as idx, string_agg(digest, '' order by idx) as preimage from upper where n > 1 group by level, idx // 8
), walk(id, lang, level, idx, beside, digest) as (
  select id, lang, 0, pos, '', coalesce(tampered, leaf) from leaves
  union all
  select w.id, w.lang, w.level + 1, w.idx // 8, beside || preimage[1:64 * (w.idx % 8)] || preimage[64 * (w.idx % 8) + 65:],
    sha256(preimage[1:64 * (w.idx % 8)] || digest || preimage[64 * (w.idx % 8) + 65:])
  from walk w join runs r on w.lang is not distinct from r.lang and w.level = r.level and w.idx // 8 = r.idx
), at_subroot as (
  select id, lang, arg_max(beside, level) as beside, arg_max(digest, level) as digest from walk group by id, lang
), climb(id, level, idx, beside, digest) as (
  select id, 0, s.pos, beside, a.digest from at_subroot a join subroots s on a.lang is not distinct from s.lang
  union all
  select c.id, c.level + 1, c.idx // 8, beside || preimage[1:64 * (c.idx % 8)] || preimage[64 * (c.idx % 8) + 65:],
    sha256(preimage[1:64 * (c.idx % 8)] || digest || preimage[64 * (c.idx % 8) + 65:])
  from climb c join upper_runs r on c.level = r.level and c.idx // 8 = r.idx
), at_root as (
  select id, arg_max(beside, level) as beside, arg_max(digest, level) as digest from climb group by id
), root as (
  select digest as root from upper where n = 1
)
select l.doc_id, l.leaf, s.digest as subroot, root, sha256(beside) as proof_sha256, a.digest as folded_root, a.digest = root as verified
from leaves l join at_root a using (id) join subroots s on l.lang is not distinct from s.lang cross join root
"""

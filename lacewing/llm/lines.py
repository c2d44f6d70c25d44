"""Fuzzy line dedup by MinHash, in DataFrame operations only."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, named, spare, stored, table

#: Characters of a shingle, the Jaccard similarity asked for, bands of a signature and minima of a band: a pair at 0.8 shares
#: a band with probability 1 - (1 - 0.8**3)**7 = 0.993, one at 0.9 with 0.9999.
N_CHARS, THRESHOLD, BANDS, ROWS = 8, 0.8, 7, 3
#: Rows of a few numbers that a side of a join may have to be broadcast, and bytes of a side that holds arrays; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: 64-bit words of the bitmap of a line's difference from its leader.
WORDS = 16

_RNG = random.Random(17)
_PIVOTS = [_RNG.getrandbits(63) for _ in range(BANDS * ROWS)]


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The stored table `df` of fixed-width rows, to be broadcast if it has at most `most` of them, a proven bound; else
    Spark shuffles as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_lists(df: DataFrame, key: str, numbers: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """The same for rows of a string `key` and an int array `numbers`, whose bytes are added up."""
    total = df.agg(F.sum(F.octet_length(key) + 4 * F.size(numbers) + 64)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def row_key() -> Column:
    """What names a row: its id and the hash of its text. Rows equal in both are one document and get the same result."""
    return F.concat_ws(":", F.lower(F.hex(F.xxhash64("text"))), F.col("doc_id").cast("string"))


def line_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(…, pos, line, id) of each line that isn't blank."""
    rows = docs.select(*more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != "").withColumn("id", F.xxhash64("line"))


def shingle_count(line: Column | str = "line", n: int = N_CHARS) -> Column:
    return F.greatest(F.length(line) - F.lit(n - 1), F.lit(1))


def signatures(lines: DataFrame, n: int = N_CHARS) -> DataFrame:
    """(id, copies, keys) of each distinct line of (id, line): how often it stands and a key for each band.

    A minimum is the shingle hash nearest by XOR to a fixed pivot, over all shingles of the line (one that is shorter than n is one
    shingle). All minima are one aggregation whose map side sees a line's shingles together, so lines are shuffled as minima,
    never as text. A row holds four shingles (the last one again, where a line ends), of which each pivot's nearest is taken first.
    """
    points = lines.select("id", shingle_count("line", n).alias("size"), F.encode("line", "UTF-32").alias("points"))
    each = points.select("id", "points", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(4))).alias("i"))
    hashes = each.select("id", "i", *[F.xxhash64(F.substring("points", F.expr(f"if(i + {j} < size, i + {j}, size - 1)") * 4 + 1, F.lit(4 * n))).alias(f"h{j}") for j in range(4)])
    less = lambda a, b: F.expr(f"if({a} < {b}, {a}, {b})")
    halves = hashes.select("id", "i", *[less(f"(h{j} ^ {p}L)", f"(h{j + 1} ^ {p}L)").alias(f"m{k}_{j}") for j in (0, 2) for k, p in enumerate(_PIVOTS)])
    mins = halves.groupBy("id").agg(F.sum(F.expr("if(i = 0, 1, 0)")).alias("copies"), *[F.min(less(f"m{k}_0", f"m{k}_2")).alias(f"m{k}") for k in range(len(_PIVOTS))])
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return mins.select("id", "copies", keys.alias("keys"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, as the only element of an array, though inner functions name it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_list(line: Column | str, n: int = N_CHARS) -> Column:
    """All shingle hashes of a line, repeats included; a line shorter than n is one shingle."""
    places = F.sequence(F.lit(1), shingle_count(line, n) * 4 - 3, F.lit(4))
    return bound(F.encode(line, "UTF-32"), lambda points: F.transform(places, lambda at: F.xxhash64(F.substring(points, at, F.lit(4 * n)))))


def compared(pairs: DataFrame, text: DataFrame, n: int) -> DataFrame:
    """(u, v, u_size, v_size, delta) of `pairs` (u, v): the sizes of the two shingle sets and what is in one of them only."""
    left = text.select(F.col("id").alias("u"), F.col("line").alias("u_line"))
    right = text.select(F.col("id").alias("v"), F.col("line").alias("v_line"))
    half = stored(pairs.join(left, "u"), "half")
    hashed = half.join(right, "v").select("u", "v", shingle_list("u_line", n).alias("a"), shingle_list("v_line", n).alias("b"))
    each = hashed.select("u", "v", F.size(F.array_distinct("a")).alias("u_size"), F.array_except("a", "b").alias("only_u"), F.array_except("b", "a").alias("only_v"))
    v_size = F.col("u_size") - F.size("only_u") + F.size("only_v")
    return each.select("u", "v", "u_size", v_size.alias("v_size"), F.concat("only_u", "only_v").alias("delta"))


def slack(threshold: float) -> float:
    """Sets are similar if they differ in at most this share of the sum of their sizes."""
    return (1 - threshold) / (1 + threshold) + 1e-12


def around_leaders(pairs: DataFrame, text: DataFrame, n: int, threshold: float) -> DataFrame:
    """(leader, id, size, apart, alike, b0, b1, …) of (id, leader) pairs, compared exactly: the line's shingles, in how many
    the two differ, whether they are similar, and a bitmap of the hashes of those."""
    sets = compared(pairs.toDF("u", "v"), text, n)
    each = sets.select(F.col("v").alias("leader"), F.col("u").alias("id"), F.col("u_size").alias("size"), F.size("delta").alias("apart"), (F.size("delta") <= slack(threshold) * (F.col("u_size") + F.col("v_size"))).alias("alike"), F.explode_outer("delta").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(h & 63 as int))")
    bits = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(WORDS)]
    return each.groupBy("leader", "id", "size", "apart", "alike").agg(*bits)


def families(near: DataFrame, company: DataFrame) -> DataFrame:
    """(node, component) of lines that are linked already: each follows its similar leader with most company, that one's own such
    leader, and once more. Lines of one component are linked; that some linked lines have different ones costs comparisons only."""
    rank = company.withColumnRenamed("id", "leader")
    led = near.where("alike").select("id", "leader").join(bounded(rank), "leader").groupBy("id").agg(F.max(F.struct("company", "leader")).alias("up"))
    led = up = stored(led.select(F.col("id").alias("node"), F.col("up.leader").alias("component")), "led")
    for _ in range(2):
        above = led.toDF("at", "above")
        up = up.join(above, up.component == above["at"], "left").select("node", F.coalesce("above", "component").alias("component"))
    return up


def maybe_similar(near: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(u, v, u_component, v_component) of lines around one leader, not yet of one component, that may be similar; no pair that is gets lost.

    Two sets differ in |X| + |Y| - 2 |X and Y| shingles, X and Y being what each of them differs in from the leader. So similar ones
    share a known number of X and Y; and no more can be shared than X has, less the bits of X that the bitmap of Y lacks.
    """
    placed = stored(near.join(found, near.id == found.node, "left").select(*near.columns, F.coalesce("component", "id").alias("component")), "placed")
    apart = stored(placed.groupBy("leader").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("leader"), "apart")
    rows = placed.drop("alike").join(bounded(apart), "leader", "left_semi")
    bits = [f"b{k}" for k in range(WORDS)]
    left, right = (rows.select("leader", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "size", "apart", "component", *bits)]) for side in "uv")
    need = (F.col("u_apart") + F.col("v_apart") - slack(threshold) * (F.col("u_size") + F.col("v_size"))) / 2
    most = lambda a, b: F.col(f"{a}_apart") - sum((F.bit_count(F.col(f"{a}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{k}")))) for k in bits[1:]), F.bit_count(F.col(f"{a}_b0").bitwiseAND(F.bitwise_not(F.col(f"{b}_b0")))))
    fits = (F.col("u_id") < F.col("v_id")) & (F.col("u_component") != F.col("v_component")) & (F.least("u_size", "v_size") >= (threshold - 1e-12) * F.greatest("u_size", "v_size"))
    fits = fits & (F.least("u_apart", "v_apart") >= need) & (most("u", "v") >= need) & (most("v", "u") >= need)
    pairs = stored(left.join(right, "leader").where(fits).select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "u_component", "v_component").distinct(), "maybe")
    discard(placed, apart)
    return pairs


def similar_lines(docs: DataFrame, n: int = N_CHARS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, copies) of each distinct line, and the (u, v) of ids that join all similar lines which share a band.

    Of each bucket the line that has most company over all bands leads, the centre of a family of near copies, and every other is
    compared with it. So a large bucket of similar lines never lists its pairs. Lines around one leader that those links leave apart
    may be similar too: their differences from the leader tell which pairs can be, and those are compared as well; of the links
    between two families already joined one is kept. All comparisons are exact and no line is dropped, whatever the size of a bucket.
    """
    signed = stored(signatures(line_rows(docs), n), "bands")
    bands = signed.select("id", F.explode("keys").alias("key"))
    shared = stored(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = stored(bands.join(bounded(shared), "key").select("key", "id", "size"), "buckets")
    company = stored(buckets.groupBy("id").agg(F.sum("size").alias("company")), "company")
    ranked = stored(buckets.join(company, "id").select("key", "id", "company"), "ranked")
    leaders = stored(ranked.groupBy("key").agg(F.max(F.struct("company", "id")).alias("lead")).select("key", F.col("lead.id").alias("leader")), "leaders")
    pairs = stored(ranked.join(leaders, "key").where("id <> leader").select("id", "leader").distinct(), "pairs")
    text = stored(line_rows(docs).join(bounded(company), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")), "text")
    near = stored(around_leaders(pairs, text, n, threshold), "near")
    alike = near.where("alike").select(F.col("id").alias("u"), F.col("leader").alias("v"))
    maybe = maybe_similar(near, families(near, company), threshold)
    close = compared(maybe.select("u", "v"), text, n).where(F.size("delta") <= slack(threshold) * (F.col("u_size") + F.col("v_size"))).select("u", "v")
    joined = stored(close, "close").join(maybe, ["u", "v"]).select(F.col("u_component").alias("u"), F.col("v_component").alias("v")).distinct()
    links = stored(alike.union(joined), "links")
    discard(shared, buckets, company, ranked, leaders, pairs, text, near, maybe)
    return signed.select("id", "copies"), links


def dedup_lines(docs: DataFrame, n: int = N_CHARS, threshold: float = THRESHOLD, counters: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of `docs`, `text` without the lines that are dropped, and in `counters` how many lines it had and lost.

    Lines are what '\\n' separates, compared as they stand. Equal lines (by a 64-bit hash), and those linked by a
    character-shingle Jaccard similarity of `threshold` or more, form a component, and the one first by (doc_id, position)
    stays; null ids come last. Rows equal in id and text are one document and change alike; rows that only share an id are ordered by
    the hash of their text. Columns of `docs` named like the counters are replaced, and all others may have any name. Blank
    lines stay. Null and empty texts are unchanged, and an empty table stays empty. A text that loses all its lines is empty. Lines may
    be of any length: their shingles are read one by one.
    """
    columns = [c for c in docs.columns if c.lower() not in counters]
    lines, links = similar_lines(docs, n, threshold)
    found = components(links, "lines")
    several = lines.where("copies > 1").select(F.col("id").alias("node"), F.col("id").alias("component"))
    groups = stored(found.union(several).groupBy("node").agg(F.min("component").alias("component")), "groups")
    occurring = line_rows(docs, row_key().alias("row"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc")).drop("line")
    places = stored(occurring.join(bounded(groups), F.col("id") == F.col("node")).select("component", "last", "doc", "row", "pos"), "places")
    first = stored(places.groupBy("component").agg(F.min(F.struct("last", "doc", "row", "pos")).alias("first")).select("component", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")), "first")
    row, gone = spare(docs, "row"), spare(docs, "gone")
    dropped = places.join(first, "component").where("row <> first_row or pos <> first_pos")
    removed = stored(dropped.groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone)), "removed")
    discard(links, groups, places, first)
    text, at = F.split("text", "\n", -1), named(gone)
    kept = bound(text, lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i)))
    joined = docs.select(*map(named, columns), row_key().alias(row)).join(bounded_lists(removed, row, gone), row, "left")
    counts = F.when(F.col("text").isNull(), 0).otherwise(F.size(text)).alias(counters[0]), F.when(at.isNull(), 0).otherwise(F.size(at)).alias(counters[1])
    left = F.when(at.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select(*[left if c == "text" else named(c) for c in columns], *counts)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, named, spare, stored, table

#: Weights that the sources get in turn, and the most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, take `weights` in turn. Together the targets are all sizes;
    a target stops at `most` times its source's size, and what is over goes to the others by weight. That
    fixed point is a level: target = min(cap, level * weight). With the sources sorted by cap/weight, the level
    after the k least are capped is (total - their caps) / (weight left), and k is the first where the next
    source isn't above its cap. One row a source is all that the single-partition windows see.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * F.lit(most)).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select("source", "source_size", "weight", "cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("used"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"), F.sum("source_size").over(everywhere).cast("double").alias("total"), F.sum("weight").over(everywhere).alias("all_weight"))
    level = (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("gone"))
    per = per.withColumn("level", F.max(F.when(F.col("cap") >= level * F.col("weight"), level)).over(everywhere))
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def draw_key() -> Column:
    """What a document's draw hangs on: its id, or, where that is null, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def copies(key: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) copies, and one more with the fraction's probability, drawn from md5 of key and seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Each row of `docs` with size, source_size, target and n_copies.

    Null text has size 0; null source is a source of its own. A source of size 0 has target 0 and rate 0. Rows
    with the same doc_id draw alike; one without doc_id draws by the hash of its text. Sources whose
    caps or weights tie are taken in code point order. The table of targets has a row a source, is stored, and Spark
    broadcasts it only if it is small; the join is split where a source is hot. An empty table gives no rows. Columns of `docs`
    with the names added here are replaced.
    """
    added = ("size", "source_size", "target", "n_copies")
    kept = [c for c in docs.columns if c.lower() not in added]
    docs = docs.select(*map(named, kept))
    targets = stored(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, most), "targets")
    own = spare(docs, "own_source")
    t = targets.withColumnRenamed("source", own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = docs.join(t, F.col("source").eqNullSafe(named(own)))
    return joined.select(*map(named, kept), word_count(F.col("text")).alias("size"), "source_size", "target", copies(draw_key(), rate, seed).alias("n_copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every document n_copies times, with the number of its copy in `copy` (from 0).

    All other columns of `docs` stay as they are, whatever their names; one named `copy` is replaced. Rows equal in all columns are
    documents of their own and draw alike; sources that tie are taken in code point order. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() != "copy"]
    held = {c: f"held_{i}" for i, c in enumerate(columns) if c.lower() not in ("doc_id", "text", "source")}
    plan = mixing_plan(docs.select(*[named(c).alias(held.get(c, c)) for c in columns]), weights, most, seed).where("n_copies > 0")
    return plan.select(*[named(held.get(c, c)).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), (F.col("n_copies") - 1).cast("int"))).alias("copy"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select source, source_size, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight, (source_size * 3)::double as cap from per
), ordered as (
  select *, coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as used,
    coalesce(sum(weight) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
    (sum(source_size) over ())::double as total, sum(weight) over () as all_weight from weighed
), leveled as (
  select *, max(case when cap >= (total - used) / (all_weight - gone) * weight then (total - used) / (all_weight - gone) end) over () as level from ordered
), targets as (
  select source, source_size, least(cap, coalesce(level, 0) * weight) as target from leveled
), rated as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5(coalesce(d.doc_id::varchar, 'text ' || md5(coalesce(d.text, ''))) || ':mix'), 1, 13))::bigint / 4503599627370496.0 as draw
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated
"""

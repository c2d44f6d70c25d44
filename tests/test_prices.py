from pyspark.sql import functions as F

from lacewing.operators import pricing
from lacewing.plans import prices
from lacewing.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_parts_are_bounded(spark, monkeypatch):
    """A task held its share of all rows, however many there were."""
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    rows = tables.table(spark, FOLDER, "lineitem").count()
    for df in (prices.listings(spark, FOLDER, dealt=True), prices.label_map(spark, FOLDER)):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > rows / 200 and max(sizes) < 400


def test_bits_are_the_families(spark):
    labels = [*pricing.FAMILIES, "other", None]
    rows = spark.createDataFrame([(x, [r for r in range(9) if (k >> r) & 1]) for x in labels for k in range(0, 512, 7)], "label string, printed array<int>")
    printed = F.aggregate("printed", F.lit(0).cast("long"), lambda bits, r: bits.bitwiseOR(pricing.rid_bit(r)))
    both = pricing.family_bits(F.col("label")).bitwiseAND(printed)
    ids = pricing.family(F.col("label"))
    told = rows.select(F.bit_count(both).alias("n"), pricing.only_rid(both).alias("only"), F.size(F.array_intersect(ids, "printed")).alias("want_n"), pricing.mapped_rid(ids, F.col("printed")).alias("want"))
    assert all(r.n == r.want_n and r.only == r.want for r in told.collect())

"""Captured listing pages: verified files, and product rows out of their markup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a capture's metadata must hold, and the kind of page that is read.
METADATA = "url string, observed_at string, status_code int, sha256 string, bytes int"
CONTENT_TYPE = r"(?i)^text/html\s*(;.*)?$"
CHARSET = "euc-kr"


def stem(path: Column) -> Column:
    """A file's name without folder and extension, by which a capture and its metadata belong together."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each JSON file: its fields, and in `fault` the first that is missing or of another type."""
    rows = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("capture"), F.try_parse_json("value").alias("v"))
    fields = [tuple(x.split()) for x in METADATA.split(", ")]
    values = {name: F.try_variant_get("v", f"$.{name}", kind) for name, kind in fields}
    right = {name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == ("STRING" if kind == "string" else "BIGINT") for name, kind in fields}
    fault = F.when(F.col("v").isNull(), "not JSON")
    for name, value in values.items():
        fault = fault.when(value.isNull() | ~F.coalesce(right[name], F.lit(False)), f"field {name}")
    kind = F.try_variant_get("v", "$.content_type", "string")
    return rows.select("capture", *[c.alias(n) for n, c in values.items()], kind.alias("content_type"), fault.alias("fault")).withColumn("observed", F.try_to_timestamp("observed_at"))


def verified(files: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """Each capture's metadata and content with its problem, null if it may be used: size and digest are those of the file of its name."""
    seen = files.select(stem(F.col("path")).alias("capture"), F.sha2("content", 256).alias("found_sha256"), F.octet_length("content").alias("found_bytes"), "content")
    problem = (
        F.coalesce(F.col("fault"), F.when(F.col("content").isNull(), "missing file").when(F.col("status_code") != 200, "status").when(F.col("found_bytes") != F.col("bytes"), "size")
        .when(F.col("found_sha256") != F.col("sha256"), "sha256").when(F.col("content_type").isNotNull() & ~F.col("content_type").rlike(CONTENT_TYPE), "content type")
        .when(F.col("observed").isNull() | ~F.col("observed_at").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), "time zone").when(F.col("observed") > as_of, "future"))
    )
    return meta.join(seen, "capture", "left").withColumn("problem", problem)


def decoded(rows: DataFrame, charset: str = CHARSET) -> DataFrame:
    """`text` of each row's bytes; null where they aren't wholly valid in the charset."""

    def strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch["content"]:
                try:
                    out.append(bytes(raw).decode(charset) if raw is not None else None)
                except UnicodeDecodeError:
                    out.append(None)
            yield batch[["url"]].assign(text=out)

    return rows.select("url", "content").mapInPandas(strict, "url string, text string")

"""Captured pages: fields and links out of HTML by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of a page's parts.
TITLE = r"<title>([^<]*)</title>"
LINK = r'href="([^"]*)"'
TAG = r"<[^>]*>"
HOST = r"^[a-z]+://([^/?#:]+)"
PATH = r"^[a-z]+://[^/?#]+([^?#]*)"
QUERY = r"\?([^#]*)"


def fields(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"), F.regexp_count("html", F.lit(LINK)).cast("long").alias("links"), F.regexp_count("html", F.lit(TAG)).cast("long").alias("tags"), F.octet_length("html").cast("long").alias("bytes"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, url) of each link in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("place", "url"))


def url_parts(url: Column) -> dict[str, Column]:
    return {"host": F.regexp_extract(url, HOST, 1), "path": F.regexp_extract(url, PATH, 1), "query": F.regexp_extract(url, QUERY, 1)}

"""Listing paths by globs over the addresses of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.plans.registry import query
from spandrel.sources import globs
from spandrel.sources.tables import read

INCLUDE, EXCLUDE = ["*/{en,de}/[1-4]*", "**/*.html"], ["m.*/**", "*/*/3?"]
LISTED_SQL = """
WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS p FROM u),
l AS (SELECT page_id, path FROM s WHERE ((len(p) = 3 AND p[2] IN ('en', 'de') AND regexp_matches(p[3], '^[1-4]') AND NOT starts_with(p[1], '.') AND p[1] <> '') OR (p[-1] LIKE '%.html' AND len(list_filter(p, lambda x: x = '' OR starts_with(x, '.'))) = 0))
  AND NOT (starts_with(p[1], 'm.') AND len(p) > 1 AND len(list_filter(p[2:], lambda x: x = '' OR starts_with(x, '.'))) = 0) AND NOT (len(p) = 3 AND length(p[3]) = 2 AND starts_with(p[3], '3') AND p[1] <> '' AND p[2] <> '' AND NOT starts_with(p[1], '.') AND NOT starts_with(p[2], '.')))
"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.where(globs.matching(F.col("path"), INCLUDE, EXCLUDE))


@query(LISTED_SQL + "SELECT page_id, path FROM l")
def glob_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir)


@query(LISTED_SQL + "SELECT path FROM l ORDER BY path LIMIT 1000")
def glob_listing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand of them."""
    return globs.first(listed(spark, sf_dir).select("path"), 1000)

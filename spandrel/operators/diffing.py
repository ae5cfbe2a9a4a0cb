"""Differences between two snapshots, and diff text as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators.intervals import overlapping

HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def changes(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """key and change_kind (added, deleted, modified) by one full outer join; equal rows are left out."""
    b, h = base.select(key, F.col(value).alias("_b"), F.lit(True).alias("_inb")), head.select(key, F.col(value).alias("_h"), F.lit(True).alias("_inh"))
    both = b.join(h, key, "full_outer")
    kind = F.when(F.col("_inb").isNull(), "added").when(F.col("_inh").isNull(), "deleted").when(~F.col("_b").eqNullSafe(F.col("_h")), "modified")
    return both.select(key, kind.alias("change_kind")).where("change_kind IS NOT NULL")


def added(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    return head.join(base.select(key), key, "left_anti")


def deleted(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    return base.join(head.select(key), key, "left_anti")


def modified_by_hunks(functions: DataFrame, hunks: DataFrame, side: str = "new") -> DataFrame:
    """functions (file, start, end, ...) that some hunk of their file overlaps; ``side`` old compares with old line numbers."""
    spans = hunks.select("file", F.col(f"{side}_start").alias("start"), (F.col(f"{side}_start") + F.greatest(F.col(f"{side}_count") - 1, F.lit(0))).alias("end"))
    return overlapping(functions, spans, "file")


def hunks(patches: DataFrame) -> DataFrame:
    """hunk_no (from 0), old and new start and count, and content of each hunk of each (file, patch). A missing count is 1."""
    parts = F.split("patch", "(?m)^(?=@@ )", -1)
    rows = patches.select("file", F.posexplode(F.filter(parts, lambda x: x.rlike("^" + HUNK))).alias("hunk_no", "content"))
    number = lambda g, other: F.when(F.regexp_extract("content", HUNK, g) == "", F.lit(other)).otherwise(F.regexp_extract("content", HUNK, g)).cast("int")
    return rows.select("file", "hunk_no", number(1, "0").alias("old_start"), number(2, "1").alias("old_count"), number(3, "0").alias("new_start"), number(4, "1").alias("new_count"), F.regexp_replace("content", r"^[^\n]*\n?", "").alias("content"))


def has_change(content: str = "content") -> F.Column:
    return F.exists(F.split(content, "\n", -1), lambda x: x.startswith("+") | x.startswith("-"))


def multiset_difference(current: DataFrame, baseline: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``current`` beyond as many equal ones in ``baseline``; the later duplicates stay. Rows keep all columns."""
    counts = baseline.groupBy(*keys).agg(F.count("*").alias("_n"))
    nth = current.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    joined = nth.alias("c").join(counts.alias("b"), [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.where(F.col("_rn") > F.coalesce("_n", F.lit(0))).select("c.*").drop("_rn")

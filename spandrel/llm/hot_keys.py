"""Splitting groups and joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize

#: Rows of keys that may be broadcast, and rows of a key from which on its join is broadcast: at least the first, and at least one in so many of all rows.
MOST_KEYS, HOT_ROWS, HOT_SHARE = 100_000, 10_000, 1000


def blocks_of_hot_keys(rows: DataFrame, key: str, weight: Column, limit: int, bucket: str, node: str) -> DataFrame:
    """``rows`` with part, low, high and block: groups of (part, low, high) hold every pair of rows of one ``key``.

    A key (long) whose ``weight`` is ``limit`` at most goes with its bucket, and low = high. A hotter one is cut into blocks by a hash of ``node``: each pair of blocks
    low < high, and each block with itself, is a group of its own.
    """
    hot = materialize(rows.groupBy(key).agg(F.sum(weight).alias("weight")).where(F.col("weight") > limit).select(key, F.ceil(F.col("weight") / limit).cast("int").alias("blocks")))
    cold = lambda df: df.select("*", F.col(bucket).cast("long").alias("part"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(0).alias("block"))
    n = hot.count()
    if not n:
        return cold(rows)
    hot = F.broadcast(hot) if n <= MOST_KEYS else hot
    cut = rows.join(hot, key).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select(*rows.columns, F.col(key).alias("part"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    return cold(rows.join(hot.select(key), key, "left_anti").select(*rows.columns)).unionAll(cut)


def joined_back(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with the unique ``keys`` of ``table``, whose column rows says how many rows each has; the hot ones are broadcast, at most HOT_SHARE of them."""
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(table.where(F.col("rows") > limit).drop("rows"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col("rows") <= limit).drop("rows"), keys))

"""Running sums, highest and lowest values along the rows of a key, however many rows one key has.

Rows of ordinary keys meet in one window. A key with over ``LEAST`` rows and over one in ``HOT_SHARE`` of all is cut into ranges of its order; each range is folded by a window of its own, and what the
ranges before it give is carried on by a small table: a row for each range and hot key, so at most a few thousand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators.storage import written

LEAST, HOT_SHARE = 100_000, 1000
#: How two values of a fold meet; nulls count for nothing.
MEET: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, broadcast if it is small."""
    table = written(table)
    return F.broadcast(table) if table.count() <= most else table


def cut(rows: DataFrame, key: list[str], order: list[str], least: int | None = None) -> DataFrame:
    """``rows``, with the column _part if a key is hot: rows of one key and part are one range of the order."""
    least = LEAST if least is None else least
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    total, top = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(least, total // HOT_SHARE)
    if top <= limit:
        return rows
    hot = written(sizes.where(F.col("_n") > limit).select(*(F.col(c).alias(f"_{c}") for c in key), "_n"))
    n = hot.agg(F.sum("_n")).first()[0]
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    cold = rows.join(F.broadcast(hot), same, "left_anti").withColumn("_part", F.lit(0))
    own = rows.join(F.broadcast(hot), same, "left_semi").withColumn("_row", F.monotonically_increasing_id())
    ranges = own.repartitionByRange(-(-n // limit) + 1, *key, *order, "_row").withColumn("_part", F.spark_partition_id() + 1)
    return cold.unionByName(written(ranges.drop("_row")))


def scan(rows: DataFrame, key: list[str], order: list[str], exclusive: bool = False, **folds: tuple[str, Column]) -> DataFrame:
    """``rows`` of cut() with a column for each of ``folds`` (a name of MEET, a value): over the rows of its key up to this one, or up to the one before."""
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    parted = "_part" in rows.columns
    w = Window.partitionBy(*key, *["_part"] * parted).orderBy(*order).rowsBetween(*frame)
    local = rows.withColumns({name: MEET[how][0](value).over(w) for name, (how, value) in folds.items()})
    if not parted:
        return local
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("_part > 0").groupBy(*key, "_part").agg(*(MEET[how][0](value).alias(f"_{name}") for name, (how, value) in folds.items()))
    carried = totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*key, "_part"]), *(MEET[how][0](f"_{name}").over(before).alias(f"_{name}") for name, (how, _) in folds.items()))
    joined = local.join(F.broadcast(carried), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*key, "_part"]], "left")
    return joined.withColumns({name: MEET[how][1](F.col(name), F.col(f"_{name}")) for name, (how, _) in folds.items()}).select(*local.columns)

"""Event-sourced task store: appended events, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.scalar import TERMINAL, clamp_progress
from spandrel.operators import ordered

#: Next state by (state, event); other events leave the state as it is.
TRANSITIONS = {("PENDING", "start"): "IN_PROGRESS", ("IN_PROGRESS", "complete"): "COMPLETED", ("IN_PROGRESS", "fail"): "FAILED", ("FAILED", "retry"): "PENDING", ("PENDING", "cancel"): "CANCELLED", ("IN_PROGRESS", "cancel"): "CANCELLED", ("IN_PROGRESS", "pause"): "PENDING", ("PENDING", "resume"): "IN_PROGRESS"}


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key: a map-side combine, then one row a key is shuffled."""
    rest = [c for c in events.columns if c != key]
    top = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def newest(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """Newest first; with a limit a top-k without a full sort."""
    out = df.orderBy(*(F.col(c).desc() for c in order))
    return out if n is None else out.limit(n)


def newest_per(df: DataFrame, key: str, n: int, *order: str, rank: str | None = None) -> DataFrame:
    """The ``n`` last rows of each key, with their ``rank`` from the end; every task sends at most n rows of a key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    top = df.withColumn("_rn", rn).where(F.col("_rn") <= n)
    return top.withColumnRenamed("_rn", rank) if rank else top.drop("_rn")


def by_id(tasks: DataFrame, key: str, ids: list) -> DataFrame:
    """The tasks of some ids; the filter reaches the scan."""
    return tasks.where(F.col(key).isin(ids))


def is_terminal(status: Column | str) -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*TERMINAL)


def stale_sweep(tasks: DataFrame, now: Column, hours: int = 8) -> DataFrame:
    """task_id and action (delete or cancel) of tasks not updated for ``hours``."""
    old = tasks.where(F.col("updated_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return old.select("task_id", F.when(is_terminal("status"), "delete").otherwise("cancel").alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the highest version of each key."""
    return latest(old.unionByName(new), key, version)


def update(task: DataFrame, change: DataFrame) -> DataFrame:
    """tasks (task_id, status, progress, metadata map, retry_count, version) after changes (same, nulls keep the old; expected_version must match if given)."""
    c = change.select("task_id", *(F.col(x).alias(f"_{x}") for x in ("status", "progress", "metadata", "retry", "expected_version")))
    fits = F.col("_expected_version").isNull() | (F.col("_expected_version") == F.col("version"))
    merged = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(F.coalesce("_metadata", F.create_map().cast("map<string,string>")), k)), F.coalesce("_metadata", F.create_map().cast("map<string,string>")))
    hit = F.col("_hit") & fits
    j = task.join(c.withColumn("_hit", F.lit(True)), "task_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return j.select(
        "task_id",
        F.when(hit, F.coalesce("_status", "status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.coalesce(clamp_progress("_progress"), "progress")).otherwise(F.col("progress")).alias("progress"),
        F.when(hit, merged).otherwise(F.col("metadata")).alias("metadata"),
        (F.col("retry_count") + F.when(hit & F.coalesce("_retry", F.lit(False)), 1).otherwise(0)).alias("retry_count"),
        (F.col("version") + F.when(hit, 1).otherwise(0)).alias("version"),
    )


def deleted(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("task_id"), "task_id", "left_anti")


def replay(events: DataFrame) -> DataFrame:
    """Final state of each task from its ordered events (task_id, ordinal, event)."""
    table = F.create_map(*(F.lit(x) for (s, e), t in TRANSITIONS.items() for x in (f"{s}>{e}", t)))
    ordered = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "event"))).alias("e"))
    state = F.aggregate("e", F.lit("PENDING"), lambda s, x: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), x["event"])), s))
    return ordered.select("task_id", state.alias("status"))


def evicted(files: DataFrame, now: Column, ttl: int, capacity: int, least: int | None = None) -> DataFrame:
    """id of cached files (id, created, size) that go: the expired, then the oldest until the rest fits.

    Newest first, what goes over the capacity is what does not fit behind newer files: a running sum, which is cut into ranges of that order where the files are many.
    """
    live = files.select("id", "created", "size", (F.col("created") < now - ttl).alias("_expired"))
    aged = live.where("NOT _expired").select("id", "size", F.lit(0).alias("_all"), (-F.col("created")).alias("_age"), (-F.col("id")).alias("_no"))
    order = ["_age", "_no"]
    kept = ordered.scan(ordered.cut(aged, ["_all"], order, least), ["_all"], order, _sum=("sum", F.col("size")))
    return live.where("_expired").select("id").unionAll(kept.where(F.col("_sum") > capacity).select("id"))

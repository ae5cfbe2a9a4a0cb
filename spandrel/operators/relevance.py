"""What a change report shows beside the graph: bodies of affected functions, levels, results of tasks, and figures of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.scalar import number_lines
from spandrel.operators.graph import first_by


def is_comment_or_blank(line: Column, prefixes: Column) -> Column:
    """Whether a trimmed line is empty or begins with one of the comment ``prefixes`` of its language."""
    trimmed = F.trim(line)
    return (trimmed == "") | F.exists(prefixes, lambda p: trimmed.startswith(p))


def reached(impact: DataFrame) -> DataFrame:
    """Rows of an impact report without the changed nodes themselves."""
    return impact.where("level > 0")


def by_level(impact: DataFrame, key: str = "start") -> DataFrame:
    """How many nodes, and of how many types, lie at each level of each start; the nodes stay rows of ``impact``."""
    return impact.groupBy(key, "level").agg(F.count("*").alias("n_nodes"), F.countDistinct("type").alias("n_types"))


def bodies(names: DataFrame, functions: DataFrame) -> DataFrame:
    """``names`` (name as ``Class.method`` or ``function``) with the body of the first function (class_name, name, ordinal, body) so called; a null class is empty."""
    first = first_by(functions.withColumn("class_name", F.coalesce("class_name", F.lit(""))), ["class_name", "name"], "ordinal").select(F.col("class_name").alias("_c"), F.col("name").alias("_f"), "body")
    parts = F.split("name", r"\.")
    asked = names.withColumn("_c", F.when(F.size(parts) > 1, parts[0]).otherwise("")).withColumn("_f", F.element_at(parts, -1))
    return asked.join(first, ["_c", "_f"], "left").drop("_c", "_f")


def affected_bodies(impact: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``impact`` (name, start_line, ...) beyond the changed nodes, with old_code and new_code, the latter with line numbers."""
    both = bodies(bodies(reached(impact), old).withColumnRenamed("body", "old_code"), new).withColumnRenamed("body", "new_code")
    return both.withColumn("new_code", number_lines("new_code", F.col("start_line")))


def with_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with their results (task_id, result), null if there is none."""
    return tasks.join(results, "task_id", "left")


def unique_inputs(tasks: DataFrame) -> DataFrame:
    """The first task of each type and input_hash; tasks without a hash all stay."""
    hashed = tasks.where("input_hash IS NOT NULL")
    return first_by(hashed, ["type", "input_hash"], "task_id").select(*tasks.columns).unionByName(tasks.where("input_hash IS NULL"))


def throughput(runs: DataFrame, key: str) -> DataFrame:
    """n_files, files a second, share of successes and peak memory of each ``key`` from rows (elapsed_ms, ok, memory)."""
    return runs.groupBy(key).agg(
        F.count("*").alias("n_files"),
        F.round(F.count("*") / (F.sum("elapsed_ms") / 1000), 6).alias("files_per_second"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"),
        F.max("memory").alias("peak_memory"),
    )


def line_total(start_row: Column, end_row: Column) -> Column:
    return end_row - start_row + 1

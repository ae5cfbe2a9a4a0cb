"""Interval operators. No pair of ranges is made that is not part of a result.

Merging, overlap and the ranks of holes are running values along one order (ordered.py). Containment goes by a tree of cells whose widths are powers of two: a range covers exactly a few cells, two a
level at most, and a point lies in one cell a level, so a range holds a point if and only if they share one cell. Positions are integers; both ends belong to a range.

Rows with a null key, start or end overlap nothing, hold nothing and are held by nothing; ``merge`` takes null keys as one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators import ordered
from spandrel.operators.storage import written

#: A key with at most so many outer ranges is joined with all of them: about as many rows as a point has cells.
FEW = 32


def merge(ranges: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 1, least: int | None = None) -> DataFrame:
    """Union of the ranges of each key; neighbours up to ``gap`` apart are one."""
    rows = ordered.cut(ranges.select(key, start, end), [key], [start, end], least)
    reached = ordered.scan(rows, [key], [start, end], exclusive=True, _reach=("max", F.col(end)))
    fresh = F.when(F.col(start) <= F.col("_reach") + gap, 0).otherwise(1)
    island = ordered.scan(reached, [key], [start, end], _island=("sum", fresh))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract(ranges: DataFrame, holes: DataFrame, key: str, start: str = "start", end: str = "end", least: int | None = None) -> DataFrame:
    """What is left of each range (with its id, unique inside a key) after cutting the holes of its key; pieces keep end points in common with the holes.

    Holes are merged first, so those of a key stand in one order. Running counts of their ends along all positions tell the first and last hole that touches a range; a range meets
    these alone, by their numbers. A range that a hole covers wholly disappears.
    """
    merged = ordered.cut(written(merge(holes, key, start, end, gap=0, least=least)), [key], [start], least)
    numbered = ordered.scan(merged, [key], [start], _no=("sum", F.lit(1).cast("long")))
    numbered = written(ordered.scan(numbered, [key], [start], exclusive=True, _before=("max", F.col(end))).select(key, F.col(start).alias("_hs"), F.col(end).alias("_he"), "_no", "_before"))
    at = lambda df, pos, kind: df.select(key, F.col(pos).alias("_at"), F.lit(kind).alias("_kind"), *(["id"] if "id" in df.columns else [F.lit(None).alias("id")]))
    # At one position holes begin before ranges end, and ranges begin before holes end.
    events = at(numbered, "_hs", 0).unionAll(at(ranges, end, 1)).unionAll(at(ranges, start, 2)).unionAll(at(numbered, "_he", 3))
    order = ["_at", "_kind"]
    counted = ordered.scan(ordered.cut(events, [key], order, least), [key], order, _begun=("sum", (F.col("_kind") == 0).cast("long")), _over=("sum", (F.col("_kind") == 3).cast("long")))
    touched = counted.where("_kind IN (1, 2)").groupBy(key, "id").agg(F.max(F.when(F.col("_kind") == 2, F.col("_over"))).alias("_first"), F.max(F.when(F.col("_kind") == 1, F.col("_begun"))).alias("_last"))
    own = ranges.select(key, "id", F.col(start).alias("_s"), F.col(end).alias("_e")).join(touched, [key, "id"])
    free = own.where("_last <= _first").select(key, "id", F.col("_s").alias(start), F.col("_e").alias(end))
    met = own.where("_last > _first").select("*", F.explode(F.sequence(F.col("_first") + 1, F.col("_last"))).alias("_no")).join(numbered, [key, "_no"])
    since = F.when(F.col("_no") == F.col("_first") + 1, F.col("_s")).otherwise(F.col("_before"))
    left = met.where(F.col("_hs") > since).select(key, "id", since.alias(start), F.col("_hs").alias(end))
    right = met.where("_no = _last AND _he < _e").select(key, "id", F.col("_he").alias(start), F.col("_e").alias(end))
    return left.unionByName(right).unionByName(free)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (a_end >= b_start)


def overlapping(left: DataFrame, right: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Rows of ``left`` (key, start, end) that overlap some row of ``right``: of the rows of ``right`` that begin by a row's end, the furthest reaches its start."""
    whole = F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    begun = right.where(whole).select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_reach"))
    asked = left.where(whole).withColumns({"_at": F.col("end"), "_kind": F.lit(1)})
    order = ["_at", "_kind"]
    both = ordered.cut(asked.unionByName(begun, allowMissingColumns=True), [key], order, least)
    return ordered.scan(both, [key], order, _furthest=("max", F.col("_reach"))).where("_kind = 1 AND _furthest >= start").select(*left.columns)


def cells(start: Column, end: Column) -> Column:
    """The fewest cells (level, cell) that make up a range: at a level of width w, those between ceil(start / w) and floor((end + 1) / w) that no wider cell takes."""
    width = lambda level: F.lit(2).cast("double") ** level
    lo = lambda level: F.ceil(start / width(level)).cast("long")
    hi = lambda level: F.floor((end + 1) / width(level)).cast("long")
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    cell = lambda level, at, here: F.when(here, F.struct(level.cast("int").alias("level"), at.alias("cell")))
    two = lambda level: F.array(cell(level, lo(level), (lo(level) < hi(level)) & odd(lo(level))), cell(level, hi(level) - 1, (lo(level) < hi(level)) & odd(hi(level))))
    levels = F.sequence(F.lit(0), F.floor(F.log2((end - start + 1).cast("double"))).cast("int") + 1)  # one more: the logarithm is rounded
    return F.filter(F.flatten(F.transform(levels, two)), lambda x: x.isNotNull())


def smallest_container(inner: DataFrame, outer: DataFrame, key: str, least: int | None = None, few: int = FEW) -> DataFrame:
    """For each row of ``inner`` (key, id, start, end), the id of the smallest row of ``outer`` that holds it; ties go to the smallest id.

    Keys with few outer ranges are joined on the key. Otherwise an outer range stands in its cells and an inner one asks the cells of its start: in a cell all outer ranges hold that start, so the smallest
    that ends late enough is a running minimum from the last end down. The lowest answer of all cells holds.
    """
    whole = F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end"))
    inner, outer = inner.where(whole).select(key, "id", "start", "end"), outer.where(whole).select(key, "id", "start", "end")
    size = F.struct((F.col("end") - F.col("start")).alias("width"), F.col("id").alias("id"))
    large = written(outer.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.col("end") - F.col("start") + 1).alias("_width")).where(F.col("_n") > few).select(F.col(key).alias("_k"), "_width"))
    wide = large.agg(F.max("_width")).first()[0]
    plain = lambda df: df if wide is None else df.join(large, F.col(key) == F.col("_k"), "left_anti")
    o = plain(outer).select(F.col(key).alias("_ok"), F.col("start").alias("_os"), F.col("end").alias("_oe"), size.alias("_best"))
    found = plain(inner).join(o, (F.col(key) == F.col("_ok")) & (F.col("_os") <= F.col("start")) & (F.col("_oe") >= F.col("end"))).select("id", "_best")
    if wide is not None:
        many = lambda df: df.join(large, F.col(key) == F.col("_k"), "left_semi")
        held = many(outer).select(key, F.explode(cells(F.col("start"), F.col("end"))).alias("c"), (-F.col("end")).alias("_at"), F.lit(0).alias("_kind"), size.alias("_own")).select(key, "c.*", "_at", "_kind", "_own")
        width = F.lit(2).cast("double") ** F.col("level")
        asked = many(inner).select(key, "id", "start", (-F.col("end")).alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(max(0, wide.bit_length() - 1)))).alias("level"))
        asked = asked.select(key, "level", F.floor(F.col("start") / width).cast("long").alias("cell"), "_at", F.lit(1).alias("_kind"), "id")
        node, order = [key, "level", "cell"], ["_at", "_kind"]
        asked = asked.join(held.select(*node).distinct(), node, "left_semi")
        both = ordered.cut(written(held.unionByName(asked, allowMissingColumns=True)), node, order, least)
        best = ordered.scan(both, node, order, _best=("min", F.col("_own"))).where("_kind = 1 AND _best IS NOT NULL")
        found = found.unionByName(best.select("id", "_best"))
    return found.groupBy("id").agg(F.min("_best").alias("_best")).select("id", F.col("_best.id").alias("container_id"))


def added_blocks(lines: DataFrame) -> DataFrame:
    """Runs of consecutive '+' lines of each hunk as 0-based rows of the new file.

    ``lines``: hunk, ordinal, new_start (1-based), line. Lines with '-' do not advance the new file.
    """
    order = Window.partitionBy("hunk").orderBy("ordinal")
    mark = F.substring("line", 1, 1)
    at = lines.select("hunk", "ordinal", (mark == "+").alias("_plus"), (F.col("new_start") - 1 + F.sum(F.when(mark == "-", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.when(mark == "-", 0).otherwise(1)).alias("row"))
    runs = at.withColumn("_run", F.sum(F.when(F.col("_plus"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_plus").groupBy("hunk", "_run").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row")).drop("_run")


def line_offsets(lines: DataFrame) -> DataFrame:
    """Character offset of each line (doc_id, line_no, line), a newline between lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", "line_no", (F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") - 1).cast("long").alias("start_offset"), F.length("line").cast("long").alias("line_length"))

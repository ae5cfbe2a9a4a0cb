"""Content of a change: the ranges of changed and related nodes, merged, cut out of their files and numbered.

Positions are 0-based code points, ends exclusive. Ranges of a file meet as one array of merged ones; each text is read once. Texts are cut by a small helper, which counts lines once per text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.scalar import normalize_path
from spandrel.operators import intervals, related
from spandrel.operators.storage import bounded_batches

# What counts as white space, the mark of what is left out, and the heading of a file.
SPACE = " \t\n\r\f\v\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
CUT = "\n<- CUT CONTENT ->\n"
HEADING = "<-- {} -->\n"


def functions_of(functions: DataFrame, path: Column) -> DataFrame:
    """Rows of ``functions`` (key, file, ...) of one file, with name: the last part of the key."""
    return functions.where(normalize_path("file") == normalize_path(path)).withColumn("name", F.element_at(F.split("key", ":"), -1))


def nodes_of(nodes: DataFrame, path: Column) -> DataFrame:
    """Nodes whose path contains ``path``."""
    return nodes.where(F.col("path").contains(path))


def last_match(items: Column, holds) -> Column:
    """0-based place of the last item for which ``holds``, -1 if there is none."""
    return F.coalesce(F.array_max(F.filter(F.transform(items, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())), F.lit(-1))


def cut_out(text: str, ranges: list[tuple[int, int]], comments: list[str]) -> str:
    """The ranges' lines up to their last line of code, numbered; marks stand for what is left out between, before and after them."""
    if not text or not ranges:
        return ""
    breaks, prefixes, slices = [m.start() for m in re.finditer("\n", text)], tuple(comments), []
    row = lambda i: bisect_left(breaks, i)
    for start, end in ranges:
        lines = text[start:end].split("\n")
        code = [i for i, x in enumerate(lines) if (t := x.strip(SPACE)) and not t.startswith(prefixes)]
        if code:
            first = next(i for i, x in enumerate(lines) if x.strip(SPACE))
            slices.append("\n".join(f"{row(start) + 1 + i}: {lines[i]}".strip(SPACE) for i in range(first, code[-1] + 1)))
    out = f"\n{CUT}\n".join(slices)
    if row(ranges[0][0]) > 0:
        out = f"{CUT}\n{out}"
    last = row(ranges[-1][1])
    if last < len(breaks) and text[breaks[last] + 1 :].strip(SPACE):
        out = f"{out}\n{CUT}"
    return out


def assembled(ranges: DataFrame, texts: DataFrame, key: str = "path") -> DataFrame:
    """key and content of each file with ranges (key, start, end): ``texts`` has key, text and comments (prefixes of comment lines); a null text or a file that is missing gives no row."""
    bounded_batches(ranges.sparkSession)
    merged = intervals.merge(ranges.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), key)
    of_file = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    # The ranges are the small side by far: texts are shuffled to them, but not sorted.
    met = texts.where("text IS NOT NULL").select(key, "text", "comments").join(of_file.hint("shuffle_hash"), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "comments")), strict=True)
            content = [cut_out(t, [(r["start"], r["end"]) for r in rs], c or []) for t, rs, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(content, pa.string())], [key, "content"])

    return met.select(key, "text", "ranges", "comments").mapInArrow(run, f"{key} {dict(met.dtypes)[key]}, content string")


def node_ranges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, start and end of what each node (id, type, name, start, end, constructor: the language's name for it) shows: all of it, but a class without its methods other than the constructor."""
    whole = nodes.where("start IS NOT NULL AND end IS NOT NULL")
    classes = whole.where(F.col("type") == related.CLASS).select("id", "start", "end")
    own = edges.where(F.col("type") == related.METHOD).select(F.col("src").alias("id"), F.col("dst").alias("_m")).distinct()
    methods = whole.where((F.col("type") == related.FUNCTION) & ~F.col("name").eqNullSafe(F.col("constructor"))).select(F.col("id").alias("_m"), "start", "end")
    holes = own.join(methods, "_m").select(F.col("id").alias("_class"), "start", "end")
    left = intervals.subtract(classes.select(F.col("id").alias("_class"), "id", "start", "end"), holes, "_class").select("id", "start", "end")
    return whole.where(F.col("type") != related.CLASS).select("id", "start", "end").unionByName(left)


def imports_of(nodes: DataFrame, resolved: DataFrame, root: str, paths: DataFrame) -> DataFrame:
    """request and id of IMPORT nodes that mean a path of ``paths`` (request, path) below ``root``; resolved: id and resolved of import nodes."""
    inside = nodes.where(F.col("type") == related.IMPORT).select("id").join(resolved.where(F.col("resolved").startswith(root)), "id")
    return inside.join(paths.select("request", F.col("path").alias("resolved")), "resolved").select("request", "id")


def relevant(changed: DataFrame, nodes: DataFrame, edges: DataFrame, resolved: DataFrame, texts: DataFrame, root: str = "", direction: str = "BOTH") -> DataFrame:
    """request, path and content of every file that a change shows.

    changed: request (a reviewed file), path (its path), id (a changed node of it). Shown are the changed nodes, the nodes related to them, and in other files the imports of the reviewed one. nodes: id, type, name, path,
    start, end, constructor. resolved: id, resolved of import nodes. texts: path, text, comments.
    """
    near = related.related(nodes, edges, direction, starts=changed.select(F.col("id").alias("start")))
    shown = changed.select("request", "id").union(changed.join(near.select(F.col("start").alias("id"), "other"), "id").select("request", "other")).distinct()
    at = nodes.select("id", "path")
    files = shown.join(at, "id").select("request", "path").distinct()
    main = changed.select("request", F.col("path").alias("main")).distinct()
    named = imports_of(nodes, resolved, root, main.select("request", F.col("main").alias("path"))).join(at, "id").join(files, ["request", "path"], "left_semi").join(main, "request").where("path <> main")
    every = shown.unionByName(named.select("request", "id")).distinct()
    unit = every.join(at, "id").join(node_ranges(nodes, edges), "id").select("request", "path", "start", "end").withColumn("unit", F.to_json(F.struct("request", "path")))
    units = unit.select("unit", "request", "path").distinct()
    found = assembled(unit, units.join(texts, "path").select("unit", "text", "comments"), "unit")
    return found.join(units, "unit").select("request", "path", F.concat(F.lit(HEADING.split("{}")[0]), "path", F.lit(HEADING.split("{}")[1]), "content").alias("content"))

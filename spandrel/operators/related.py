"""Related nodes: one hop by a table of rules, and the classes of functions in other files, for all nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators.storage import dealt, written

FUNCTION, CLASS, IMPORT, METHOD = "FUNCTION", "CLASS", "IMPORT", "HAS_METHOD"
# Kinds of edges that relate nodes of a type.
RULES = [(FUNCTION, "CALLS"), (FUNCTION, METHOD), (CLASS, METHOD), (CLASS, "EXTENDS"), (CLASS, "IMPLEMENTS"), (CLASS, "IMPLEMENTED_BY"), (CLASS, "EXTENDED_BY")]


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (src, dst, type) whose ends exist, with src_type, src_path, dst_type and dst_path. Edges pass by hashed nodes and are not sorted."""
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"), F.col("path").alias(f"{c}_path")).hint("shuffle_hash")
    once = dealt(edges.select("src", "dst", "type"), "src", "dst", "type").distinct()
    return dealt(dealt(once, "src").join(end("src"), "src"), "dst").join(end("dst"), "dst")


def related(nodes: DataFrame, edges: DataFrame, direction: str = "TO", kinds: list[str] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """start, other, edge_type and hop of the nodes related to each of ``starts`` (start), or to every node.

    nodes: id, type, path. Hop 1 follows incoming edges (TO), outgoing ones (FROM) or both, of the kinds that RULES gives the start's type; ``kinds`` keeps some types of nodes. Hop 2 adds, for each
    related function of another file, the classes whose method it is. A loop relates a node to itself once.
    """
    ends = written(with_ends(edges, nodes))
    views = {
        "TO": ends.select(F.col("dst").alias("start"), F.col("dst_type").alias("_kind"), F.col("dst_path").alias("_path"), "type", F.col("src").alias("other"), F.col("src_type").alias("_type"), F.col("src_path").alias("_at")),
        "FROM": ends.select(F.col("src").alias("start"), F.col("src_type").alias("_kind"), F.col("src_path").alias("_path"), "type", F.col("dst").alias("other"), F.col("dst_type").alias("_type"), F.col("dst_path").alias("_at")),
    }
    seen = views["TO"].unionAll(views["FROM"].where("start <> other")) if direction == "BOTH" else views[direction]
    rules = nodes.sparkSession.createDataFrame(RULES, "_kind string, type string")
    hop = seen.join(F.broadcast(rules), ["_kind", "type"])
    if starts is not None:
        hop = hop.join(starts.select("start").distinct(), "start", "left_semi")
    if kinds:
        hop = hop.where(F.col("_type").isin(kinds))
    foreign = hop.where((F.col("_type") == FUNCTION) & (F.col("_at") != F.col("_path"))).select("start", F.col("other").alias("dst"))
    classes = dealt(foreign, "dst").join(ends.where((F.col("type") == METHOD) & (F.col("src_type") == CLASS)).select("dst", "src").hint("shuffle_hash"), "dst")
    classes = dealt(classes.select("start", "src"), "start", "src").distinct()
    return hop.select("start", "other", F.col("type").alias("edge_type"), F.lit(1).alias("hop")).unionAll(classes.select("start", F.col("src").alias("other"), F.lit(METHOD).alias("edge_type"), F.lit(2).alias("hop")))

"""Conversation prefix trie, summed over subtrees by heavy-path decomposition.

Rebuilt conversations: a conversation takes its first turns from the one that opens its hundred (``opening``). A node is a distinct sequence of first turns,
known by its depth and two 64-bit exclusive ors over hashes of (place, role, text): what a turn adds depends on its place alone, so running values are made in segments of ``SEGMENT``
turns, and a node's parent is its own key without its last turn.

Each node's heavy child is the one with most members. A heavy path runs down to a leaf; the nodes of a leaf's first conversation below the last light one are that leaf's path, and the light
nodes above them are its level. A light child has at most half its parent's members, so there are at most log2(conversations) levels. From the deepest level up, a round adds what light paths
brought to their parents, sums each path from its end (again by segments), and hands the sums of the heads on.

Hot keys: common turns are counted with partial aggregation; parents and nodes of many rows are broadcast (hot_keys.joined_back); conversations with over a
thousandth of all turns are cut into ranges to be numbered. The list of conversations that end in a node is made from blocks of ``BLOCK`` ids, which are hashed one after the other.

Defined results: turns with a null conv_id belong to no conversation and are left out; equal turns of a conversation are all kept, in the order of role and text; a null role or text is empty; very long texts
count whole; other columns are not read, whatever their names; an empty table has no root and gives an empty result. The remainder of a negative conv_id is negative.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.hot_keys import joined_back
from spandrel.llm.lineage import materialize
from spandrel.operators.storage import shared_folder

#: Turns of a segment, ids of a block, most opening turns, and conversations that share an opening.
SEGMENT, BLOCK, MOST_OPENING, HUNDRED = 4096, 4096, 5, 100
#: A conversation is numbered in ranges if it has more turns, and over one in HOT_SHARE of all.
LONG, HOT_SHARE = 50_000, 1000
NODE = ["depth", "x", "y"]


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % (MOST_OPENING + 1)).cast("int")


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("turn", "role", "text")


def numbered(turns: DataFrame, about: DataFrame, long: int) -> DataFrame:
    """``turns`` with pos (from 1) and the columns of ``about`` (conv_id, n, ...)."""
    total = about.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(long, total // HOT_SHARE)
    hot = about.where(F.col("n") > limit)
    rows = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = turns if not rows else turns.join(F.broadcast(hot.select("conv_id")), "conv_id", "left_anti")
    out = few.withColumn("pos", F.row_number().over(in_order("conv_id"))).join(about, "conv_id")
    if not rows:
        return out
    cut = turns.join(F.broadcast(hot), "conv_id").withColumn("_own", F.monotonically_increasing_id())
    cut = materialize(cut.repartitionByRange(-(-rows // limit) + 1, "conv_id", "turn", "role", "text", "_own").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("conv_id", "_part").agg(F.count("*").alias("_n")).select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("pos", F.row_number().over(in_order("conv_id", "_part"))).join(F.broadcast(starts), ["conv_id", "_part"])
    return out.unionByName(placed.withColumn("pos", (F.col("pos") + F.col("_before")).cast("int")).drop("_own", "_part", "_before"))


def running(rows: DataFrame, key: str, values: list[str], fold: Callable, plus: Callable, up: bool = False) -> DataFrame:
    """``rows`` (key, depth, size, ...) with ``values`` folded from the first depth to each row's, or from the last if ``up``. size: the last depth of the key; its segments are folded apart and carried on."""
    rows = rows.withColumn("_segment", F.floor(F.col("depth") / SEGMENT))
    order = lambda *by, at: Window.partitionBy(*by).orderBy(F.desc(at) if up else F.asc(at))
    here = order(key, "_segment", at="depth").rowsBetween(Window.unboundedPreceding, 0)
    before = order(key, at="_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(F.col("size") >= SEGMENT).groupBy(key, "_segment").agg(*(fold(v).alias(v) for v in values))
    carried = totals.select(key, "_segment", *(fold(v).over(before).alias(f"_{v}") for v in values)).where(F.col(f"_{values[0]}").isNotNull())
    local = rows.select(*[c for c in rows.columns if c not in values], *(fold(v).over(here).alias(v) for v in values))
    joined = local.join(carried, [key, "_segment"], "left")
    return joined.withColumns({v: plus(F.col(v), F.coalesce(F.col(f"_{v}"), F.lit(0).cast("long"))) for v in values}).drop("_segment", *(f"_{v}" for v in values))


def rebuilt(conversations: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, x and y of the turn alone, chars, size), and conv_id and size of each."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = turns.where(F.col("conv_id") % HUNDRED == 0).withColumn("pos", F.row_number().over(in_order("conv_id"))).where(F.col("pos") <= MOST_OPENING)
    first = materialize(first.select(F.col("conv_id").alias("opener"), "pos", "role", "text"))
    known = first.groupBy("opener").agg(F.max("pos").alias("_have"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("opener"), opening(F.col("conv_id")).alias("taken"))
    lead = F.least("taken", F.coalesce("_have", F.lit(0)))
    about = materialize(convs.join(known, "opener", "left").select("conv_id", "n", "opener", "taken", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).cast("long").alias("size")))
    own = numbered(turns, about, long).where(F.col("pos") > F.col("taken")).select("conv_id", (F.col("lead") + F.col("pos") - F.col("taken")).cast("long").alias("depth"), "role", "text", "size")
    taken = about.join(first, "opener").where(F.col("pos") <= F.col("taken")).select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text", "size")
    marks = [F.xxhash64("depth", "role", "text").alias("x"), F.xxhash64(F.lit("y"), "text", "role", "depth").alias("y")]
    return own.unionByName(taken).select("conv_id", "depth", *marks, F.length("text").cast("long").alias("chars"), "size"), about.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the keys of the nodes they lead to (x, y), and of these nodes' parents (above_x, above_y)."""
    own = turns.withColumns({"above_x": F.col("x"), "above_y": F.col("y")})
    found = running(own, "conv_id", ["x", "y"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return found.withColumns({"above_x": F.col("x").bitwiseXOR(F.col("above_x")), "above_y": F.col("y").bitwiseXOR(F.col("above_y"))})


def nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: its key and its parent's, conv_id, n_convs, chars, n_children, parent_conv_id and light (whether another child of the parent is its heavy one)."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), F.lit(None).cast("long").alias("above_x"), F.lit(None).cast("long").alias("above_y"), "conv_id", "n_convs", zero.alias("chars"))
    deeper = steps.groupBy(*NODE).agg(F.max("above_x").alias("above_x"), F.max("above_y").alias("above_y"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    found = materialize(root.unionByName(deeper.select(*root.columns)))
    upward = found.where("depth > 0").withColumns({"_depth": F.col("depth") - 1, "_x": F.col("above_x"), "_y": F.col("above_y")})
    children = upward.groupBy("_depth", "_x", "_y").agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", (-F.col("conv_id")).alias("c"))).alias("_heavy"))
    children = children.select(F.col("_depth").alias("depth"), F.col("_x").alias("x"), F.col("_y").alias("y"), "n_children", "_heavy")
    full = materialize(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = full.where("n_children > 0").select(F.col("depth").alias("_depth"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("conv_id").alias("parent_conv_id"), F.col("_heavy").alias("_first"), F.col("n_children").alias("rows"))
    below = joined_back(upward.select(*NODE, "conv_id", "_depth", "_x", "_y"), parents, ["_depth", "_x", "_y"]).select(*NODE, "parent_conv_id", (F.col("conv_id") != F.col("_first")).alias("light"))
    return materialize(full.drop("_heavy").join(below, NODE, "left").withColumn("light", F.coalesce("light", F.lit(False))))


def paths(tree: DataFrame, steps: DataFrame) -> tuple[DataFrame, int]:
    """``tree`` with path (the leaf's first conversation), size (its depth) and level (light nodes down to the path's own head), and the number of levels."""
    leaves = tree.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("size"))
    zero = F.lit(0).cast("long")
    walked = steps.select(F.col("conv_id").alias("path"), *NODE).join(leaves, "path").select("path", *NODE, "size").unionByName(leaves.select("path", *(zero.alias(c) for c in NODE), "size"))
    flagged = joined_back(walked, tree.select(*NODE, F.col("light").cast("long").alias("level"), F.col("n_convs").alias("rows")), NODE)
    counted = materialize(running(flagged.select("path", *NODE, "size", "level"), "path", ["level"], F.sum, lambda a, b: a + b))
    # the level at a leaf is its path's: a node that is no deeper in light ones is on that path
    ends = counted.where("depth = size").select("path", F.col("level").alias("_level"))
    own = counted.join(ends, "path").where("level = _level").drop("_level")
    folder = f"{shared_folder(tree.sparkSession)}/{uuid.uuid4().hex}"
    placed = own.join(tree, NODE)
    placed.repartition(*NODE).write.partitionBy("level").parquet(folder)
    found = tree.sparkSession.read.schema(placed.schema).parquet(folder)
    return found, (found.agg(F.max("level")).first()[0] or 0) + 1


def summed(placed: DataFrame, levels: int) -> DataFrame:
    """``placed`` with n_leaves and saved_tokens of each node's subtree: one round a level, the deepest first."""
    out, brought = [], None
    for level in range(levels - 1, -1, -1):
        own = placed.where(F.col("level") == level).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
        if brought is not None:
            more = own.join(brought, NODE, "left")
            own = more.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("n_leaves", "saved_tokens")}).drop("_n_leaves", "_saved_tokens")
        done = materialize(running(own, "path", ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b, up=True))
        heads = done.where("light").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_x").alias("x"), F.col("above_y").alias("y"))
        brought = heads.agg(F.sum("n_leaves").alias("_n_leaves"), F.sum("saved_tokens").alias("_saved_tokens"))
        out.append(done)
    return reduce(DataFrame.unionByName, out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of nodes that stand together in order: one digest a node."""
    last, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], [*NODE, "ends_sha256"])
    for batch in batches:
        for *node, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece")), strict=True):
            if node != last:
                if last:
                    yield done()
                last, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if last:
        yield done()


def ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """ends_sha256 of every node in which a conversation ends."""
    zero = F.lit(0).cast("long")
    last = steps.where("depth = size").select("conv_id", *NODE).unionByName(convs.where("size = 0").select("conv_id", *(zero.alias(c) for c in NODE)))
    ids = F.array_sort(F.collect_list("conv_id"))
    pieces = materialize(last.groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(ids.cast("array<string>"), ",").alias("piece")))
    counted = pieces.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("piece").alias("piece"))
    one = counted.where("n = 1").select(*NODE, F.sha2("piece", 256).alias("ends_sha256"))
    several = pieces.join(counted.where("n > 1").select(*NODE), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return one.unionByName(several.mapInArrow(_hashed, "depth long, x long, y long, ends_sha256 string"))


def trie(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    turns, convs = rebuilt(conversations, long)
    steps = materialize(prefixes(materialize(turns)))
    placed, levels = paths(nodes(steps, convs), steps)
    done = summed(placed, levels).join(ends(steps, convs), NODE, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: CRC-32 of the decimal conv_id, bit by bit.
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"
SQL = f"""
WITH o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
cs AS MATERIALIZED (SELECT c, c - c % 100 AS opener, {CRC_SQL} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT cs.c, 0 AS own, pos, role, text FROM cs JOIN o ON o.c = opener WHERE pos <= h UNION ALL SELECT cs.c, 1, pos, role, text FROM cs JOIN o USING (c) WHERE pos > h),
n AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM r),
p AS MATERIALIZED (SELECT c, 0 AS d, '' AS k, '' AS text FROM cs UNION ALL SELECT c, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d), text FROM n),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(length(text)) AS chars FROM p GROUP BY k, d),
children AS (SELECT k[:(d - 1) * 64] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k),
sub AS (SELECT p.k, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM node LEFT JOIN children USING (k) JOIN p ON p.c = conv_id AND p.d <= node.d GROUP BY p.k)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node a LEFT JOIN node b ON a.d > 0 AND b.d = a.d - 1 AND b.k = a.k[:(a.d - 1) * 64] LEFT JOIN children ON children.k = a.k LEFT JOIN ends ON ends.k = a.k JOIN sub ON sub.k = a.k
"""

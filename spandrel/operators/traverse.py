"""Reachability and change impact over an edge table (src, dst, type), many starts at once.

Each level is one join of the frontier with the edges; visited pairs are removed by an anti join. The loop ends with an empty frontier or at the
depth asked for. Lineage is cut by a written table every few levels, so that long paths stay cheap to plan and to recover.

Reachability from every node goes by strongly connected components (``condensed``): the closure is made over the components alone, and each node has its membership.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.storage import written

#: Nodes of a component that stand in one block, about, and pairs that a task spells out.
BLOCK, TASK_PAIRS = 1024, 10_000_000
HIGH, MEDIUM = ("CALLS", "CALLS_IMPLEMENTATION"), ("IMPLEMENTS", "EXTENDS", "IMPLEMENTED_BY")


def types(edges: DataFrame) -> DataFrame:
    """The kinds of edges that a graph has, which a walk follows unless it is given some."""
    return edges.select("type").distinct()


def steps(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """Moves (here, there): along edges (forward), against them (backward) or both."""
    kept = edges if types is None else edges.where(F.col("type").isin(types))
    forward = kept.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    backward = kept.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    moves = {"forward": forward, "backward": backward, "both": forward.unionAll(backward)}[direction]
    return moves


def levels(edges: DataFrame, starts: DataFrame, direction: str = "backward", types: list[str] | None = None, depth: int | None = None, cut_every: int = 3) -> DataFrame:
    """start, id and level (the fewest steps) of every node reachable from each row of ``starts`` (start), itself at level 0."""
    moves = steps(edges, direction, types)
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("level")).distinct()
    if depth is None or depth > cut_every:
        moves, seen = written(moves.distinct()), written(seen)
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        found = frontier.join(moves, frontier["id"] == moves["here"]).select("start", F.col("there").alias("id")).distinct()
        frontier = found.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("level", F.lit(level))
        if depth is None or depth > cut_every:
            frontier = written(frontier)
            if not frontier.take(1):
                break
        seen = seen.unionAll(frontier)
        if depth is None and level % cut_every == 0:
            seen = written(seen)
    return seen


def severity(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """id and severity of every node on an edge, by the types of its edges at either end; of the nodes in ``of`` (id) alone, if given."""
    ends = edges.select(F.col("src").alias("id"), "type").unionAll(edges.select(F.col("dst").alias("id"), "type"))
    ends = ends if of is None else ends.join(of, "id", "left_semi")
    rank = F.max(F.when(F.col("type").isin(*HIGH), 2).when(F.col("type").isin(*MEDIUM), 1).otherwise(0))
    return ends.groupBy("id").agg(rank.alias("_r")).select("id", severity_name(F.col("_r")).alias("severity"))


def severity_name(rank: Column) -> Column:
    return F.when(rank == 2, F.lit("high")).when(rank == 1, F.lit("medium")).otherwise(F.lit("low"))


def incoming(edges: DataFrame, kind: str, nodes: DataFrame | None = None, only: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Distinct id and source of incoming edges of one type; ``only`` keeps sources of one node type, ``of`` (id) some nodes."""
    found = edges.where(F.col("type") == kind).select(F.col("dst").alias("id"), F.col("src").alias("source"))
    if of is not None:
        found = found.join(of, "id", "left_semi")
    if only is not None:
        found = found.join(nodes.where(F.col("type") == only).select(F.col("id").alias("source")), "source", "left_semi")
    return found.select("id", "source").distinct()


def neighbours(edges: DataFrame, kind: str, name: str, nodes: DataFrame | None = None, only: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """id and the sorted distinct sources of its incoming edges of one type, as for incoming()."""
    return incoming(edges, kind, nodes, only, of).groupBy("id").agg(F.array_sort(F.collect_list("source")).alias(name))


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "backward", types: list[str] | None = None, depth: int | None = None, only: str | None = None, lists: bool = True) -> DataFrame:
    """start, id, type, level and severity of every node within ``depth`` of each start, with its callers and importers; ``only`` keeps one node type.

    called_by and imported_by are lists; without ``lists`` n_called_by and n_imported_by count them, so that no hub's callers meet in one array. Edges are read once, and only those of reached nodes are grouped.
    """
    edges = written(edges)
    reached = written(levels(edges, starts, direction, types, depth))
    kept = reached.join((nodes if only is None else nodes.where(F.col("type") == only)).select("id", "type"), "id")
    ids = reached.select("id").distinct()
    out = kept.join(severity(edges, ids), "id", "left").withColumn("severity", F.coalesce("severity", F.lit("low")))
    for kind, name in (("CALLS", "called_by"), ("IMPORTS", "imported_by")):
        if lists:
            out = out.join(neighbours(edges, kind, name, of=ids), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
        else:
            counts = incoming(edges, kind, of=ids).groupBy("id").agg(F.count("*").alias(f"n_{name}"))
            out = out.join(counts, "id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    names = ("called_by", "imported_by") if lists else ("n_called_by", "n_imported_by")
    return out.select("start", "id", "type", "level", "severity", *names)


def summary(report: DataFrame) -> DataFrame:
    """Per start: nodes reached, highest level, and nodes by type as a map."""
    by_type = report.groupBy("start", "type").agg(F.count("*").alias("n"), F.max("level").alias("top"))
    return by_type.groupBy("start").agg(F.sum("n").alias("total_impact"), F.max("top").alias("highest_level"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("impact_by_type"))


def _without_chains(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges past nodes with one way in and one way out, and those nodes (v, u, w) round by round: u leads to v, v to w.

    A round takes nodes no two of which are neighbours, about a third of each chain, so a cycle or chain of any length is gone after logarithmically many.
    """
    taken = []
    while True:
        into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n"), F.min("src").alias("u")).where("n = 1").select("v", "u")
        out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"), F.min("dst").alias("w")).where("n = 1").select("v", "w")
        single = written(into.join(out, "v").withColumn("rank", F.xxhash64("v", F.lit(len(taken)))))
        other = single.select(F.col("v").alias("o"), F.col("rank").alias("other"))
        free = single
        for end in ("u", "w"):
            free = free.join(other, free[end] == other["o"], "left").where("other IS NULL OR rank < other OR (rank = other AND v < o)").select("v", "u", "w", "rank")
        free = written(free.select("v", "u", "w"))
        if free.count() * 20 <= edges.count():
            return edges, taken
        taken.append(free)
        gone = free.select("v")
        left = edges.join(gone, edges["src"] == gone["v"], "left_anti").join(gone, edges["dst"] == gone["v"], "left_anti")
        edges = written(left.unionAll(free.where("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))).distinct())


def _trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges between nodes that have both a way in and a way out; the others are components of their own."""
    for _ in range(rounds):
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
    return written(edges)


def _coloured(edges: DataFrame) -> DataFrame:
    """node and colour: the first node, in the order of a hash, that reaches it. Colours of colours are taken too, which shortens long ways.

    By hash, colours cut a chain of components in the middle, about; by name, those in the order of their names would be found one after another.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = written(nodes.withColumn("colour", F.struct(F.xxhash64("node").alias("rank"), "node")))
    before = None
    while True:
        come = edges.join(colours, edges["src"] == colours["node"]).select(F.col("dst").alias("node"), "colour")
        least = colours.select("node", "colour").unionAll(come).groupBy("node").agg(F.min("colour").alias("colour"))
        up = least.select(F.col("node").alias("_first"), F.col("colour").alias("_up"))
        colours = written(least.join(up, F.col("colour.node") == F.col("_first"), "left").select("node", F.coalesce("_up", "colour").alias("colour")))
        state = colours.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return colours.select("node", F.col("colour.node").alias("colour"))
        before = state


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (src, dst).

    Chains are passed over; then, until no edge is left, nodes without a way in or out are trimmed, every node takes the colour of the first node that reaches it, and what reaches
    that node again inside its colour is a component (forward-backward colouring). Edges between colours belong to no component. Nodes of chains join where both their ends did.
    """
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    plain = written(edges.where("src <> dst").select("src", "dst").distinct())
    left, taken = _without_chains(plain)
    found = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        left = _trimmed(left)
        if not left.take(1):
            break
        colours = _coloured(left)
        c, d = (colours.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")) for end in ("src", "dst"))
        inside = written(left.join(c, "src").join(d, "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("colour")))
        known = fresh = written(colours.where("node = colour").select("node", "colour"))
        while fresh.take(1):
            back = inside.join(fresh.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            fresh = written(back.join(known, ["node", "colour"], "left_anti"))
            known = known.unionAll(fresh)
        known = written(known)
        found = found.unionAll(known.select("node", F.col("colour").alias("component")))
        done = known.select("node")
        left = inside.join(done, inside["src"] == done["node"], "left_anti").join(done, inside["dst"] == done["node"], "left_anti").select("src", "dst")
    for chain in reversed(taken):
        u, w = (found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in "uw")
        ends = chain.join(u, "u", "left").join(w, "w", "left").select("v", F.coalesce("_u", "u").alias("a"), F.coalesce("_w", "w").alias("b"))
        found = written(found.unionAll(ends.where("a = b").select(F.col("v").alias("node"), F.col("a").alias("component"))))
    named = every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("_name"))
    least = named.groupBy("_name").agg(F.min("node").alias("component"))
    return written(named.join(least, "_name").select("node", "component"))


def acyclic_closure(edges: DataFrame) -> DataFrame:
    """src, dst and level (the fewest steps) of every two nodes of a graph without cycles (src, dst) that a way leads between.

    The length doubles round by round: a longer way starts with one of just that length, and what is left of it is known. So rounds are logarithmically many in the longest way.
    """
    known, length = written(edges.select("src", "dst", F.lit(1).alias("level")).distinct()), 1
    while True:
        far = known.where(F.col("level") == length).select("src", F.col("dst").alias("via"))
        if not far.take(1):
            return known
        rest = known.select(F.col("src").alias("via"), "dst", (F.col("level") + length).alias("level"))
        found = known.unionByName(far.join(rest, "via").select("src", "dst", "level"))
        known, length = written(found.groupBy("src", "dst").agg(F.min("level").alias("level"))), 2 * length


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, component) of the strongly connected components of ``edges``, and links (component, reached) to every other component that one reaches."""
    members = strong_components(edges)
    a, b = (members.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst"))
    between = written(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    if not between.take(1):
        return members, between.select(F.col("src").alias("component"), F.col("dst").alias("reached"))
    return members, acyclic_closure(between).select(F.col("src").alias("component"), F.col("dst").alias("reached"))


def spelled_out(starts: DataFrame, reached: DataFrame, members: DataFrame) -> DataFrame:
    """start and id of every start (start, component) and every member (node, component) of the components that its own one reaches (component, reached).

    Starts and members of a component stand in blocks; a pair of blocks is a numbered cell, and a merge join by cells spells it out, so neither a large component nor the pairs themselves pass through a shuffle.
    The join is compiled and takes several times less than exploding arrays. A task takes cells by hash and gives the same ids in the same order for each start of a cell, which files store in little space.
    """

    def blocks(d: DataFrame, node: str) -> DataFrame:
        large = d.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)  # a row for 1,024 nodes at most
        block = F.pmod(F.xxhash64(node), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))
        return written(d.join(F.broadcast(large), "component", "left").select("component", block.alias("block"), node))

    sizes = lambda d, name: d.groupBy("component", "block").agg(F.count("*").alias(name))
    a, b = blocks(starts, "start"), blocks(members, "node")
    to = sizes(b, "m").withColumnsRenamed({"component": "reached", "block": "to"})
    cells = written(sizes(a, "n").join(reached, "component").join(to, "reached").withColumn("cell", F.monotonically_increasing_id()))
    total = cells.agg(F.sum(F.col("n") * F.col("m").cast("double"))).first()[0]
    tasks = min(50_000, int((total or 0) // TASK_PAIRS) + starts.sparkSession.sparkContext.defaultParallelism)
    left = a.join(cells.select("component", "block", "cell"), ["component", "block"]).select("cell", "start")
    right = b.join(cells.select(F.col("reached").alias("component"), F.col("to").alias("block"), "cell"), ["component", "block"]).select("cell", F.col("node").alias("id"))
    return left.repartition(tasks, "cell").join(right.repartition(tasks, "cell").hint("merge"), "cell").select("start", "id")

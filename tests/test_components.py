"""Strongly connected components and the condensed closure against plain Python."""

import random

from pyspark.sql import functions as F

from spandrel.operators import traverse


def brute(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {n} for n in nodes}
    nxt = {n: {b for a, b in edges if a == n} for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            for b in nxt[stack.pop()] - out[n]:
                out[n].add(b)
                stack.append(b)
    comp = {n: min(m for m in out[n] if n in out[m]) for n in nodes}
    return comp, {(comp[a], comp[b]) for a in nodes for b in out[a] if comp[a] != comp[b]}


def check(spark, edges):
    members, links = traverse.condensed(spark.createDataFrame(edges, "src string, dst string"))
    comp, reached = brute(set(edges))
    got = [tuple(r) for r in members.select("node", "component").collect()]
    assert len(got) == len(comp) and dict(got) == comp
    assert sorted(tuple(r) for r in links.select("component", "reached").collect()) == sorted(reached)


def test_random_graphs_of_several_densities(spark):
    for seed, n, m in ((1, 30, 30), (2, 40, 60), (3, 25, 70)):
        rng = random.Random(seed)
        check(spark, [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)])


def test_chains_cycles_loops_and_repeats(spark):
    cycle = lambda names: list(zip(names, names[1:] + names[:1], strict=True))
    check(spark, [("a", "a"), ("a", "b"), ("b", "c"), ("b", "c"), *cycle(["p", "q"]), *cycle([f"x{i:02}" for i in range(17)]), ("x03", "a"), *[(f"y{i:02}", f"y{i + 1:02}") for i in range(15)], ("y15", "x00"), ("c", "y07")])


def test_a_giant_cycle_has_no_links_and_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    monkeypatch.setattr(traverse, "written", lambda df, real=traverse.written: rounds.append(1) or real(df))
    members, links = traverse.condensed(spark.range(n).selectExpr("cast(id AS string) AS src", f"cast((id + 1) % {n} AS string) AS dst"))
    assert members.groupBy("component").count().collect() == [("0", n)] and links.count() == 0
    assert len(rounds) < 150


def test_an_empty_graph(spark):
    members, links = traverse.condensed(spark.createDataFrame([], "src string, dst string"))
    assert members.count() == links.count() == 0


def test_a_large_component_is_spelled_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(traverse, "BLOCK", 16)
    monkeypatch.setattr(traverse, "TASK_PAIRS", 1000)
    members = spark.createDataFrame([(f"a{i}", "a") for i in range(200)] + [("b", "b"), ("c", "c")], "node string, component string")
    starts = members.where("node not in ('a7', 'c')").withColumnRenamed("node", "start")
    reached = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("b", "a"), ("b", "c")], "component string, reached string")
    got = traverse.spelled_out(starts, reached, members)
    a = [f"a{i}" for i in range(200)]
    want = [(s, i) for s in a if s != "a7" for i in a] + [("b", i) for i in [*a, "b", "c"]]
    assert sorted((r.start, r.id) for r in got.collect()) == sorted(want)
    tasks = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 20 and max(tasks) < len(want) / 5


def test_pairs_are_spelled_out_by_a_compiled_join_without_exploding(spark, monkeypatch):
    monkeypatch.setattr(traverse, "BLOCK", 8)
    members = spark.createDataFrame([(f"a{i}", "a") for i in range(50)] + [(f"b{i}", "b") for i in range(3)] + [("c", "c")], "node string, component string")
    reached = spark.createDataFrame([(x, x) for x in "abc"] + [("a", "b"), ("a", "c"), ("b", "c")], "component string, reached string")
    got = traverse.spelled_out(members.withColumnRenamed("node", "start"), reached, members)
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(3)]
    assert sorted(map(tuple, got.collect())) == sorted([(s, i) for s in a for i in [*a, *b, "c"]] + [(s, i) for s in b for i in [*b, "c"]] + [("c", "c")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" in plan


def test_a_long_chain_of_components_takes_few_rounds(spark, monkeypatch):
    """Names go up along the chain, which finds components one after another where the first name wins."""
    rounds = []
    monkeypatch.setattr(traverse, "written", lambda df, real=traverse.written: rounds.append(1) or real(df))
    trios = [[f"{k:02}{x}" for x in "abc"] for k in range(12)]
    edges = [(x, y) for t in trios for x in t for y in t if x != y] + [(t[2], u[0]) for t, u in zip(trios, trios[1:], strict=False)]
    check(spark, edges)
    assert len(rounds) < 100


def test_the_closure_of_an_acyclic_graph_has_the_fewest_steps(spark):
    edges = [(i, i + 1) for i in range(20)] + [(2, 9), (9, 17), (0, 2), (30, 5), (30, 31), (31, 6)]
    got = {(r.src, r.dst): r.level for r in traverse.acyclic_closure(spark.createDataFrame(edges + edges[:3], "src int, dst int")).collect()}
    want = {}
    for start in {a for a, _ in edges}:
        here, level = {start}, 0
        while here:
            here, level = {b for a, b in edges if a in here} - {b for a, b in want if a == start}, level + 1
            want |= {(start, b): level for b in here}
    assert got == want

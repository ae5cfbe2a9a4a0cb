"""Declarations of single texts, edges across files, and tables written on the way."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spandrel.functions import scalar
from spandrel.operators import graph, resolve, similarity, storage
from spandrel.sources import declarations, parse
from spandrel.streaming import streams


def of(lang, text, kind):
    return [r for r in parse.extract("f", lang, text) if r["kind"] == kind]


def names(lang, text, kind):
    return [r["name"] for r in of(lang, text, kind)]


def test_blanking_keeps_offsets():
    text = 'a("x /* y"); // z\n/* m\nn */ b(\'q\');'
    quiet = declarations.blank("typescript", text)
    assert len(quiet) == len(text) and quiet.count("\n") == text.count("\n")
    assert quiet.split() == ['a("', '");', "b('", "');"]


def test_comments_and_strings_hold_nothing():
    text = '// class A { run() { go(); } }\nconst s = "function f() { g(); }";\n/* import x from "y"; */\n'
    assert parse.extract("f", "typescript", text)[1:] == []
    assert parse.extract("f", "ruby", "# def a\n=begin\ndef b\nend\n=end\n")[1:] == []


def test_chains_yield_their_last_call():
    calls = of("typescript", "function f() { a.b(g(1)).c(); this.x.y(); if (z) { new Q(); h; } }", "call")
    assert [(c["name"], c["caller"]) for c in calls] == [("g", ""), ("c", "a"), ("y", "x")]


def test_calls_belong_to_the_innermost_function():
    rows = parse.extract("f", "typescript", "function f() {\n const g = (a) => { in1(); };\n in2();\n}\n")
    by_id = {r["id"]: r["name"] for r in rows if r["kind"] == "function"}
    assert [(c["name"], by_id[c["owner_id"]]) for c in rows if c["kind"] == "call"] == [("in1", "g"), ("in2", "f")]


def test_constructor_parameters_name_the_caller():
    for lang, text in {
        "typescript": "class A { constructor(private b: B) {} run() { this.b.go(); } }",
        "java": "class A { A(B b) {} void run() { this.b.go(); } }",
        "php": "<?php class A { function __construct(private B $b) {} function run() { $this->b->go(); } }",
        "python": "class A:\n    def __init__(self, b: B): pass\n    def run(self): self.b.go()\n",
    }.items():
        assert [(c["name"], c["caller"]) for c in of(lang, text, "call")] == [("go", "B")], lang


def test_ruby_ends():
    text = "class A\n  def a(x)\n    if x\n      1\n    end\n    y = 2 if x\n    while x do\n      z\n    end\n  end\n  def b = 1\n  def c\n  end\nend\ndef d\nend\n"
    assert [(f["name"], f["class_name"], f["start_line"], f["end_line"]) for f in of("ruby", text, "function")] == [("a", "A", 2, 10), ("b", "A", 11, 11), ("c", "A", 12, 13), ("d", "", 15, 16)]


def test_odd_texts():
    assert [(r["kind"], r["parse_ok"]) for r in parse.extract("f", "python", "def f(:")] == [("file", False)]
    assert [(r["kind"], r["parse_ok"]) for r in parse.extract("f", None, "x")] == [("file", False)]
    assert [(r["kind"], r["parse_ok"]) for r in parse.extract("f", "go", "func f() {}")] == [("file", False)]
    for lang in declarations.QUIET:
        for text in ("{", ")))", "class", "class A {", "fn f(", "def", "end end", "'", "/*", "type X =", "é" * 50):
            parse.extract("f", lang, text)
        assert len(parse.extract("f", lang, "x = 1;\n" * 20_000)) >= 1


def test_a_broken_file_has_its_row(spark):
    files = spark.createDataFrame([("a.py", "python", "def f(:"), ("b.py", "python", "x = 1"), ("c.py", "python", None)], "path string, lang string, text string")
    assert {(r.file, r.parse_ok) for r in parse.parsed(files).where("kind = 'file'").collect()} == {("a.py", False), ("b.py", True), ("c.py", False)}


def test_implementations_by_file_and_name(spark):
    functions = spark.createDataFrame([("f1", "go", "a.ts", "A", 1), ("f2", "go", "b.ts", "B", 1), ("f3", "go", "c.ts", "C", 1), ("u", "run", "u.ts", "", 1)], "id string, name string, file string, class_name string, ordinal int")
    types = spark.createDataFrame([("A", "a.ts", ["i.ts::I"], 2), ("B", "b.ts", ["i.ts::I"], 1), ("C", "c.ts", ["j.ts::I"], 1)], "name string, file string, implements array<string>, ordinal int")
    calls = spark.createDataFrame([("u", "go", "i.ts", "I", 1), ("u", "go", "j.ts", "X", 2)], "function_id string, callee string, target_file string, caller string, ordinal int")
    assert [(r.src, r.dst) for r in graph.implementation_calls(functions, types, calls).collect()] == [("u", "f2")]


def test_owner_update(spark):
    nodes = spark.createDataFrame([("1", None, "a"), ("2", "X", "b")], "id string, owner string, path string")
    owners = spark.createDataFrame([("1", "A", "p", 1), ("1", "B", "q", 2), ("9", "C", "r", 3)], "id string, owner string, path string, ordinal int")
    assert {(r.id, r.owner, r.path) for r in graph.with_owners(nodes, owners).collect()} == {("1", "B", "q"), ("2", "X", "b")}


def test_candidates_against_all_pairs(spark):
    rows = [(i, "k" if i % 5 else None, None if i == 7 else " ".join(f"w{(i * 7 + j * (i % 3 + 1)) % 23}" for j in range(i % 9))) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, key string, text string")
    sets = {i: set((t or "").split()) for i, k, t in rows if k and t is not None}
    want = {(a, b) for a in sets for b in sets if a != b and (2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))}
    got = [(r.new_id, r.known_id) for r in similarity.candidates(d, d, ["key"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_sets_of_all_sizes_in_many_buckets(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "BUCKET_SETS", 7)
    monkeypatch.setattr(similarity, "TILE", 50)
    draw = random.Random(3)
    bases = [draw.sample(range(3000), size) for size in (1, 2, 3, 4, 8, 16, 33, 150, 700)]
    texts = {tuple(sorted({w if draw.random() < share else draw.randrange(3000) for w in draw.choice(bases)})) for share in (0.95, 0.8, 0.7) for _ in range(60)}
    sets = [(i % 2, f"s{i}", [f"w{w}" for w in t]) for i, t in enumerate(sorted(texts))]
    got = {(r.key, r.one, r.other): r.similarity for r in similarity.similar_sets(spark.createDataFrame(sets, "key int, set string, words array<string>"), ["key"], threshold).collect()}
    want = {}
    for k, s, w in sets:
        for j, o, v in sets:
            if k == j and s < o and len({*w} & {*v}) >= threshold * len({*w} | {*v}) - 1e-9:
                want[k, s, o] = len({*w} & {*v}) / len({*w} | {*v})
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_similar_sets_write_a_row_a_set(spark, monkeypatch):
    """Neither words nor pairs that only meet on some of them are written: with 200 sets of 170 words no table has more rows than there are sets."""
    sets = spark.createDataFrame([(0, f"s{i}", [f"own{i}_{j}" for j in range(150)] + [f"rare{j}" for j in range(20)]) for i in range(200)], "key int, set string, words array<string>")
    tables, write = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(write(df)) or tables[-1])
    assert similarity.similar_sets(sets, ["key"], 0.5).count() == 0
    assert max(t.count() for t in tables) <= 200


def test_drain_writes_a_batch_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in") + "/")
    again = lambda batch, epoch: batch.count()
    assert sorted(r.id for r in streams.drain(stream, each=again).collect()) == list(range(10))


def test_written_tables_can_be_removed(spark):
    df = storage.written(spark.range(3))
    assert df.count() == 3
    storage.clean(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).select(F.col("id")).collect()


def test_small_scalars(spark):
    row = spark.sql("SELECT map('a', '1', 'b', '2') AS o, map('b', '3') AS n, CAST(NULL AS map<string,string>) AS z, array('x', 'y', 'x') AS s").select(
        scalar.deep_merge(F.col("o"), F.col("n")).alias("m"), scalar.deep_merge(F.col("o"), F.col("z")).alias("k"), scalar.tagged_json(F.col("s"), "Set").alias("t"), scalar.untagged_map(F.lit('{"__type":"Set","value":[]}')).alias("u"),
        *(scalar.relative_path(F.lit(a), F.lit(b)).alias(f"r{i}") for i, (a, b) in enumerate([("/a/b", "/a/b"), ("", "a/b"), ("/a/b", "/"), ("/a/./b/..", "/a/c")])),
    ).first()
    assert (row.m, row.k, row.t, row.u) == ({"a": "1", "b": "3"}, {"a": "1", "b": "2"}, '{"__type":"Set","value":["x","y"]}', None)
    assert (row.r0, row.r1, row.r2, row.r3) == ("", "a/b", "../..", "c")


def test_rows_of_few_files_are_held_at_once():
    files = pd.DataFrame({"path": [f"f{i}.py" for i in range(1001)], "lang": "python", "text": "def a(): return b()\ndef b(): pass\n"})
    got = list(parse.frames(iter([files])))
    assert all(f["file"].nunique() <= parse.FILES for f in got) and len(pd.concat(got)) == 4 * 1001


def test_of_equal_texts_one_is_read(monkeypatch):
    calls, read = [], declarations.read
    monkeypatch.setattr(declarations, "read", lambda *a: calls.append(a) or read(*a))
    text = "class A { run() { go(); } }\n"
    files = pd.DataFrame({"path": [f"f{i}.ts" for i in range(90)], "lang": "typescript", "text": [text, text, text + "\n"] * 30})
    got = pd.concat(list(parse.frames(iter([files]))))
    assert len(calls) == 2 and len(got) == 4 * 90 and got["id"].nunique() == 2 * 90
    assert list(got[got["file"] == "f7.ts"]["owner_id"].dropna()) == [parse.make_id("f7.ts", ["A"], "run", 1)]


def test_imports_without_a_package_or_of_one_package_go_to_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        imports = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("typescript").alias("lang"), F.expr("if(id % 2 = 0, './b', 'react')").alias("origin"), F.lit(0).alias("ordinal"))
        found = resolve.declared(imports, spark.createDataFrame([("package.json", "react")], "path string, dependency string"))
        per_task = found.groupBy("origin", "_dep", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        for origin, dep in (("./b", None), ("react", True)):
            counts = [r.n for r in per_task if (r.origin, r._dep) == (origin, dep)]
            assert sum(counts) == 1000 and len(counts) == 4 and max(counts) < 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

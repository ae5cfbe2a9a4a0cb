"""Related nodes and assembled content against their definitions."""

import random

from spandrel.operators import content, related

NODES = "id string, type string, path string, name string, start long, end long, constructor string"


def test_related_nodes_against_brute_force(spark):
    rng = random.Random(4)
    kinds = {f"n{i}": (rng.choice(["FUNCTION", "FUNCTION", "CLASS", "FILE"]), f"f{rng.randrange(4)}") for i in range(25)}
    edges = {(rng.choice(list(kinds)), rng.choice(list(kinds)), rng.choice(["CALLS", "HAS_METHOD", "EXTENDS", "IMPORTS"])) for _ in range(150)} | {("n1", "gone", "CALLS")}
    rules = {k: {t for a, t in related.RULES if a == k} for k, _ in related.RULES}
    nodes = spark.createDataFrame([(i, t, p) for i, (t, p) in kinds.items()], "id string, type string, path string")
    frame = spark.createDataFrame(list(edges), "src string, dst string, type string")
    for direction in ("TO", "FROM", "BOTH"):
        for only in (None, ["FUNCTION"]):
            want, second = [], set()
            for n, (kind, path) in kinds.items():
                for s, d, t in edges:
                    if t not in rules.get(kind, ()):
                        continue
                    others = ([s] if d == n and direction != "FROM" else []) + ([d] if s == n and direction != "TO" and not (direction == "BOTH" and s == d) else [])
                    for o in others:
                        if o in kinds and (only is None or kinds[o][0] in only):
                            want.append((n, o, t, 1))  # once for each relation
                            if kinds[o][0] == "FUNCTION" and kinds[o][1] != path:
                                second |= {(n, c, "HAS_METHOD", 2) for c, f, e in edges if e == "HAS_METHOD" and f == o and kinds.get(c, ("",))[0] == "CLASS"}
            got = [tuple(r) for r in related.related(nodes, frame, direction, only).collect()]
            assert sorted(got) == sorted([*want, *second])
    some = related.related(nodes, frame, "TO", starts=spark.createDataFrame([("n2",)], "start string"))
    assert {r.start for r in some.collect()} <= {"n2"}


TEXT = "import x\n\nclass C:\n    a = 1\n    def __init__(self):\n        pass\n\n    def m(self):\n        # note\n        return 1\n        # end\n\n# tail\nz = 2\n"


def at(part):
    return TEXT.index(part), TEXT.index(part) + len(part)


def test_cut_out_by_hand():
    cut = content.cut_out
    assert cut("", [(0, 1)], ["#"]) == "" == cut("a", [], ["#"])
    whole = cut(TEXT, [(0, len(TEXT))], ["#"])
    assert whole.startswith("1: import x\n2:\n3: class C:") and whole.endswith("12:\n13: # tail\n14: z = 2")
    method = at("    def m(self):\n        # note\n        return 1\n        # end\n\n")
    assert cut(TEXT, [method], ["#"]) == "\n<- CUT CONTENT ->\n\n8:     def m(self):\n9:         # note\n10:         return 1\n\n<- CUT CONTENT ->\n"
    assert cut(TEXT, [at("# tail")], ["#"]) == "\n<- CUT CONTENT ->\n\n\n\n<- CUT CONTENT ->\n"
    assert cut("\n\n  \nx", [(0, 6)], []) == "4: x"
    two = cut(TEXT, [at("import x"), at("z = 2\n")], ["#"])
    assert two == "1: import x\n\n<- CUT CONTENT ->\n\n14: z = 2"


def test_relevant_content_of_a_change(spark):
    cls, init, m = (at(p) for p in (TEXT[TEXT.index("class") : TEXT.index("# tail")], "def __init__(self):\n        pass", "def m(self):\n        # note\n        return 1"))
    other = "from a import C\ndef f():\n    C().m()\ndef g():\n    pass\n"
    nodes = [
        ("a.C", "CLASS", "r/a.py", "C", *cls, "__init__"), ("a.C.i", "FUNCTION", "r/a.py", "__init__", *init, "__init__"), ("a.C.m", "FUNCTION", "r/a.py", "m", *m, "__init__"),
        ("b.f", "FUNCTION", "r/b.py", "f", 16, 36, "__init__"), ("b.g", "FUNCTION", "r/b.py", "g", 37, len(other), "__init__"), ("b.1", "IMPORT", "r/b.py", "a", 0, 15, "__init__"), ("c.1", "IMPORT", "r/c.py", "a", 0, 3, "__init__"),
    ]
    edges = [("a.C", "a.C.i", "HAS_METHOD"), ("a.C", "a.C.m", "HAS_METHOD"), ("b.f", "a.C.m", "CALLS"), ("b.f", "b.g", "CALLS")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = sorted((r.id, r.start, r.end) for r in content.node_ranges(frame(nodes, NODES), frame(edges, "src string, dst string, type string")).where("id = 'a.C'").collect())
    assert parts == [("a.C", cls[0], m[0]), ("a.C", m[1], cls[1])]
    texts = frame([("r/a.py", TEXT, ["#"]), ("r/b.py", other, ["#"]), ("r/c.py", "abc", ["#"])], "path string, text string, comments array<string>")
    got = content.relevant(frame([("q", "r/a.py", "a.C.m")], "request string, path string, id string"), frame(nodes, NODES), frame(edges, "src string, dst string, type string"), frame([("b.1", "r/a.py"), ("c.1", "r/a.py")], "id string, resolved string"), texts, "r/")
    found = {r.path: r.content for r in got.collect()}
    assert set(found) == {"r/a.py", "r/b.py"}
    assert found["r/b.py"] == "<-- r/b.py -->\n1: from a import C\n2: def f():\n3:     C().m()\n\n<- CUT CONTENT ->\n"
    assert found["r/a.py"].startswith("<-- r/a.py -->\n\n<- CUT CONTENT ->\n\n3: class C:\n4:     a = 1\n5:     def __init__") and "10:         return 1" in found["r/a.py"]


def test_files_functions_and_last_matches(spark):
    f = spark.createDataFrame([("a/b.ts:C:m", " a\\b.ts"), ("x", "c.ts")], "key string, file string")
    from pyspark.sql import functions as F

    assert [r.name for r in content.functions_of(f, F.lit("a/b.ts")).collect()] == ["m"]
    assert content.nodes_of(spark.createDataFrame([("1", "r/a/b.ts"), ("2", "q")], "id string, path string"), F.lit("a/b")).count() == 1
    d = spark.createDataFrame([(["a", "1", "b", "2", "c"],), (["x"],), ([],)], "w array<string>")
    assert [r.p for r in d.select(content.last_match(F.col("w"), lambda x: x.rlike("[0-9]")).alias("p")).collect()] == [3, -1, -1]

"""Small fixtures with known results, and odd rows."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.functions import scalar
from spandrel.operators import diffing, graph, intervals, resolve, tasks, traverse
from spandrel.sources import parse, scan
from spandrel.streaming import streams


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, type string")


def levels(spark, pairs, start, direction="backward", depth=None):
    found = traverse.levels(edges(spark, pairs), spark.createDataFrame([(start,)], "start string"), direction, depth=depth)
    return {r.id: r.level for r in found.collect()}


def test_levels(spark):
    chain = [("a", "b"), ("b", "c")]
    assert levels(spark, chain, "c") == {"c": 0, "b": 1, "a": 2}
    assert levels(spark, chain, "c", depth=1) == {"c": 0, "b": 1}
    assert levels(spark, [("a", "b"), ("b", "c"), ("c", "a")], "a") == {"a": 0, "c": 1, "b": 2}
    assert levels(spark, [("a", "a")], "a") == {"a": 0}
    assert levels(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "d") == {"d": 0, "b": 1, "c": 1, "a": 2}
    assert levels(spark, chain, "b", "both") == {"b": 0, "a": 1, "c": 1}
    assert levels(spark, chain, "zz") == {"zz": 0}
    long = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    assert levels(spark, long, "n00", "forward") == {f"n{i:02}": i for i in range(13)}


def test_severity(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("c", "d", "IMPLEMENTS"), ("e", "f", "EXTENDED_BY"), ("g", "h", "IMPORTS")], "src string, dst string, type string")
    assert {r.id: r.severity for r in traverse.severity(e).collect()} == {"a": "high", "b": "high", "c": "medium", "d": "medium", "e": "low", "f": "low", "g": "low", "h": "low"}


def test_first_and_last_wins(spark):
    nodes = spark.createDataFrame([("1", "m", "f", None, 1), ("2", "m", "f", "C", 2), ("1", "x", "g", None, 3)], "id string, name string, path string, owner string, ordinal int")
    assert sorted((r.id, r.name) for r in graph.dedup_nodes(nodes).collect()) == [("1", "m"), ("2", "m")]
    refs = spark.createDataFrame([("m", " f", "C"), ("m", "f", "D"), ("m", "f", "")], "name string, path string, caller string")
    assert [(r.node_id, r.caller) for r in graph.lookup(refs, nodes, owner=True).collect()] == [("2", "C")]
    twice = spark.createDataFrame([("a", "b", "CALLS", "p2", 2), ("a", "b", "CALLS", "p1", 1)], "src string, dst string, type string, path string, ordinal int")
    assert [r.path for r in graph.dedup_edges(twice).collect()] == ["p1"]


def test_merge_types(spark):
    rows = [("k", ["A"], [], {"x": "1", "y": "2"}, 1), ("k", ["B", "A"], ["I"], {"y": "3"}, 2)]
    r = graph.merge_types(spark.createDataFrame(rows, "key string, extends array<string>, implements array<string>, fields map<string,string>, ordinal int")).first()
    assert (r["extends"], r["implements"], r["fields"]) == (["A", "B"], ["I"], {"x": "1", "y": "3"})


def test_hunk_overlap(spark):
    f = spark.createDataFrame([("f", 10, 20)], "file string, start int, end int")
    for a, b, hit in ((5, 9, 0), (9, 10, 1), (15, 16, 1), (1, 30, 1), (20, 25, 1), (21, 22, 0)):
        h = spark.createDataFrame([("f", a, b - a + 1)], "file string, new_start int, new_count int")
        assert diffing.modified_by_hunks(f, h).count() == hit


def test_hunks_and_blocks(spark):
    patch = "--- a\n+++ b\n@@ -5 +5 @@ def f\n+x\n@@ -10,2 +1,4 @@\n+a\n+b\n c\n-d\n+e"
    found = diffing.hunks(spark.createDataFrame([("f", patch)], "file string, patch string")).orderBy("hunk_no").collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count) for r in found] == [(5, 1, 5, 1), (10, 2, 1, 4)]
    lines = spark.createDataFrame([(1, i, 1, x) for i, x in enumerate(["+a", "+b", " c", "-d", "+e"])], "hunk int, ordinal int, new_start int, line string")
    assert sorted((r.start_row, r.end_row) for r in intervals.added_blocks(lines).collect()) == [(0, 1), (3, 3)]


def test_merge_and_subtract(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (1, 11, 12)], "k int, start int, end int")
    assert sorted((x.start, x.end) for x in intervals.merge(r, "k").collect()) == [(0, 9), (11, 12)]
    whole = spark.createDataFrame([(1, 7, 0, 10)], "k int, id int, start int, end int")
    cut = lambda holes: sorted((x.start, x.end) for x in intervals.subtract(whole, spark.createDataFrame([(1, a, b) for a, b in holes], "k int, start int, end int"), "k").collect())
    assert cut([(3, 5)]) == [(0, 3), (5, 10)]
    assert cut([(0, 10)]) == [] and cut([(20, 30)]) == [(0, 10)] and cut([(-5, 2), (8, 40)]) == [(2, 8)]
    boxes = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 10, 50), (1, 3, 10, 50)], "k int, id int, start int, end int")
    inner = spark.createDataFrame([(1, 9, 20, 30)], "k int, id int, start int, end int")
    assert intervals.smallest_container(inner, boxes, "k").first().container_id == 2


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert get(scalar.jaccard(words("a", "b"), words("b", "a"))) == 1 and get(scalar.jaccard(words("a"), words("b"))) == 0
    assert get(scalar.jaccard(words(), words())) == 1 and get(scalar.jaccard(words("a", "b"), words("a"))) == 0.5
    assert get(scalar.signature_hash(words("x", "y: int"), F.lit("r"))) == get(scalar.signature_hash(words("y: int", "x"), F.lit("r")))
    assert get(scalar.reference_path(F.lit("a/b.ts::C::m"))) == "a/b.ts" and get(scalar.reference_symbol(F.lit("a/b.ts::C::m"))) == "C::m"
    assert get(scalar.reference_path(F.lit("react"))) == "react" and get(scalar.reference_symbol(F.lit("react"))) is None
    assert get(scalar.number_lines(F.lit("a\nb"), F.lit(7))) == "7 a\n8 b" and get(scalar.number_lines(F.lit(""), F.lit(0))) == "0 "
    assert get(scalar.number_content(F.lit("\n \n  x\n\ny\n\n"), F.lit(1))) == "3:   x\n4:\n5: y"
    assert get(scalar.strip_numbering(F.lit("12 +code\n__new hunk__\n\n13  same\n  - x"))) == "+code\n\n\n same\n  - x"
    assert [get(scalar.clamp_progress(F.lit(x))) for x in (-5, 50, 120)] == [0, 50, 100] and get(scalar.clamp_progress(F.lit(None).cast("int"))) is None
    assert [get(scalar.backoff_ms(F.lit(n))) for n in range(5)] == [1000, 2000, 4000, 8000, 10000]
    assert get(scalar.routing_key(F.lit("Odd"), {"A": "a.b"})) == "ast.custom.odd" and get(scalar.routing_key(F.lit("A"), {"A": "a.b"})) == "a.b"
    assert get(scalar.redact(F.create_map(F.lit("token"), F.lit("x"), F.lit("a"), F.lit("b")))) == {"token": "[REDACTED]", "a": "b"}
    for url, ok in (("https://github.com/a/b", True), ("https://github.com/a", False), ("https://evil.com/a/b", False), ("a/b", True), ("a/b/c", False), ("ssh://x/y", False)):
        assert get(scalar.is_git_url(F.lit(url))) is ok, url


def test_multiset_difference(spark):
    rows = lambda x: spark.createDataFrame([(c, i) for i, c in enumerate(x)], "m string, i int")
    assert sorted((r.m, r.i) for r in diffing.multiset_difference(rows("eeex"), rows("eew"), ["m"], "i").collect()) == [("e", 2), ("x", 3)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_multiset_difference_counts(spark, current, baseline):
    rows = lambda x: spark.createDataFrame([(c, i) for i, c in enumerate(x)], "m string, i int")
    got = Counter(r.m for r in diffing.multiset_difference(rows(current), rows(baseline), ["m"], "i").collect())
    assert got == Counter(current) - Counter(baseline)


def test_tasks(spark):
    t = spark.createDataFrame([("t", "PENDING", 10, {"a": "1"}, 0, 1)], "task_id string, status string, progress int, metadata map<string,string>, retry_count int, version int")
    change = "task_id string, status string, progress int, metadata map<string,string>, retry boolean, expected_version int"
    r = tasks.update(t, spark.createDataFrame([("t", "FAILED", 140, {"b": "2"}, True, 1)], change)).first()
    assert (r.status, r.progress, r.metadata, r.retry_count, r.version) == ("FAILED", 100, {"a": "1", "b": "2"}, 1, 2)
    assert tasks.update(t, spark.createDataFrame([("t", "FAILED", None, None, None, 9)], change)).first().version == 1
    log = [("t", 1, "start"), ("t", 2, "fail"), ("t", 3, "retry"), ("u", 1, "cancel"), ("u", 2, "start")]
    got = tasks.replay(spark.createDataFrame(log, "task_id string, ordinal int, event string")).collect()
    assert {r.task_id: r.status for r in got} == {"t": "PENDING", "u": "CANCELLED"}
    rng = random.Random(1)
    files = [(i, rng.randrange(100), rng.randrange(50)) for i in range(60)]
    total, gone = 0, {i for i, c, _ in files if c < 20}
    for i, c, s in sorted(files, key=lambda f: (-f[1], -f[0])):
        if c >= 20:
            total += s
            if total > 500:
                gone.add(i)
    df = spark.createDataFrame(files, "id int, created int, size int")
    for least in (None, 9):  # in one window, and in ranges of the order
        assert {r.id for r in tasks.evicted(df, F.lit(100), 80, 500, least).collect()} == gone


def test_breaker():
    state = ("CLOSED", 0, 0, 0)
    for i in range(9):
        state = streams.breaker_step(state, i, False, False)
    state = streams.breaker_step(state, 9, False, True)
    assert state[0] == "CLOSED"
    state = streams.breaker_step(state, 10, False, False)
    assert state[0] == "OPEN"
    assert streams.breaker_step(state, 11, True, False)[0] == "OPEN"
    assert streams.breaker_step(state, 10 + streams.RETRY_MS, False, True)[0] == "HALF_OPEN"
    assert streams.breaker_step(state, 10 + streams.RETRY_MS, True, False)[0] == "CLOSED"


def test_stream_breaker_matches_fold(spark):
    from spandrel.plans import catalog

    d = "/root/testdata/sf0.001"
    got = {r.id: r.state for r in catalog.queries()["stream_breaker"](spark, d).collect()}
    states, expected = {}, {}
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "floor(unix_micros(cast(ts as timestamp)) / 1000) ms", "value", "event_type").collect()
    for r in sorted(rows, key=lambda r: (r.ms, r.event_id)):
        now = streams.breaker_step(states.get(r.user_id, ("CLOSED", 0, 0, 0)), r.ms, r.value > 95, r.event_type == "view")
        states[r.user_id], expected[r.event_id] = now, now[0]
    assert got == expected and "OPEN" in got.values()


SOURCES = {
    "a.py": ("python", "from .b import f as g\nclass A(B):\n    def m(self, x: int) -> str:\n        def inner():\n            return 1\n        return self.n(g(x))\n"),
    "a.ts": ("typescript", "import { X, Y as Z } from './x';\nexport class A extends B implements I, J {\n  private async run(a: string): Promise<void> {\n    this.log(a); helper(a);\n  }\n}\nconst f = (x: number): number => { return g(x); };\n"),
    "A.java": ("java", "import com.x.Y;\npublic class A extends B implements I {\n  public int add(int a, int b) { return sum(a, b); }\n}\n"),
    "a.rs": ("rust", "use crate::x::y;\nstruct S { a: i32 }\nfn run(a: i32) -> i32 { go(a) }\n"),
    "bad.py": ("python", "def f(:"),
    "a.go": ("go", "func main() {}"),
    "none.py": ("python", None),
}


def test_extract(spark):
    files = spark.createDataFrame([(p, lang, t) for p, (lang, t) in SOURCES.items()], "path string, lang string, text string")
    rows = parse.parsed(files).collect()
    of = lambda kind: {(r.file, r.name, r.class_name) for r in rows if r.kind == kind}
    assert of("function") == {("a.py", "m", "A"), ("a.py", "inner", "A"), ("a.ts", "run", "A"), ("a.ts", "f", ""), ("A.java", "add", "A"), ("a.rs", "run", "")}
    assert {(r.file, r.name, tuple(r.extends), tuple(r.implements)) for r in rows if r.kind == "type"} == {("a.py", "A", ("B",), ()), ("a.ts", "A", ("B",), ("I", "J")), ("A.java", "A", ("B",), ("I",)), ("a.rs", "S", (), ())}
    assert {(r.file, r.name, r.origin, r.alias) for r in rows if r.kind == "import"} == {("a.py", "f", ".b", "g"), ("a.ts", "X", "./x", None), ("a.ts", "Y", "./x", "Z"), ("A.java", "*", "com.x.Y", None), ("a.rs", "*", "crate::x::y", None)}
    assert {(r.file, r.name, r.caller) for r in rows if r.kind == "call"} >= {("a.py", "n", "A"), ("a.py", "g", ""), ("a.ts", "log", "A"), ("a.ts", "helper", ""), ("A.java", "sum", ""), ("a.rs", "go", "")}


def test_scan_and_manifests(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/b.TS": "let a;", "node_modules/c.js": "x", "note.txt": "t", "src/empty.rb": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.lang, r.text) for r in scan.source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "x = 1\n"), "b.TS": ("typescript", "let a;")}
    assert scan.source_files(spark, str(tmp_path), ["b."]).count() == 1
    assert scan.directory_size(spark, str(tmp_path)).first().bytes == 14
    manifests = [("requirements.txt", "a==1\n# x\nb-c>=2\n"), ("r/Cargo.toml", "[package]\nname = \"n\"\n[dependencies]\nserde = \"1\"\n[dev-dependencies]\nz = \"1\"\n"), ("composer.json", '{"require": {"v/p": "1"}}'), ("Gemfile", "gem 'rails', '1'\n"), ("Gemfile.lock", "GEM\n  specs:\n    rack (2.0)\n      dep (1)\n"), ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>art</artifactId></dependency></dependencies></project>"), ("x.csproj", '<PackageReference Include="Json" Version="1" />'), ("package.json", "broken")]
    found = scan.dependencies(spark.createDataFrame(manifests, "path string, text string")).collect()
    assert sorted(r.dependency for r in found) == ["Json", "a", "art", "b-c", "rack", "rails", "serde", "v/p"]


def test_graph_files(spark, tmp_path):
    e = edges(spark, [("a", "b")])
    scan.write_graph(spark.createDataFrame([("a",), ("b",)], "id string"), e, str(tmp_path / "g"))
    nodes, back = scan.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and sorted(back.columns) == ["dst", "src", "type"]


@pytest.mark.parametrize("base,rel,out", [("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("/a", "b/../c", "/a/c"), ("a", "../../x", "x")])
def test_joined_paths(spark, base, rel, out):
    assert spark.range(1).select(resolve.joined(F.lit(base), F.lit(rel)).alias("x")).first().x == out

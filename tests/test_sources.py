"""Globs against a plain matcher, the first paths against a sort, and the tree source on every kind of file."""

import os
import random
import re

from pyspark.sql import functions as F

from spandrel.sources import globs, scan, tree


def plain(pattern, path):
    """A matcher by recursion over names, written apart from the compiler."""

    def name(p, s, start=True):
        if not p:
            return not s
        if p[0] == "*":
            return not (start and s.startswith(".")) and any(name(p.lstrip("*"), s[i:], start and i == 0) for i in range(len(s) + 1))
        if not s:
            return False
        if p[0] == "?":
            return not (start and s[0] == ".") and name(p[1:], s[1:], False)
        if p[0] == "[" and "]" in p[2:]:
            end = p.index("]", 2)
            inner, negated = p[1:end].lstrip("!"), p[1] == "!"
            hit = any(a <= s[0] <= b for a, b in re.findall("(.)-(.)", inner)) or s[0] in re.sub("(.)-(.)", "", inner)
            return hit != negated and not (start and s[0] == ".") and name(p[end + 1 :], s[1:], False)
        return p[0] == s[0] and name(p[1:], s[1:], False)

    def walk(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            if len(ps) == 1:
                return bool(ss) and not any(x.startswith(".") for x in ss)
            return walk(ps[1:], ss) or bool(ss) and not ss[0].startswith(".") and walk(ps, ss[1:])
        return bool(ss) and bool(ss[0]) and name(ps[0], ss[0]) and walk(ps[1:], ss[1:])

    return any(walk(p.split("/"), path.split("/")) for p in globs.alternatives(pattern))


PATTERNS = ["*", "**", "**/*.ts", "src/**", "src/**/a*", "*.{ts,js}", "src/{a,b{c,d}}/*", "[a-c]*", "[!a-c]*", "?.ts", "**/.git/**", "a.b", "src/*/x?.[jt]s", "**/b/**/*.ts", "{a}", "a**b", ".*", "x[", "*/*"]


def test_globs_against_a_plain_matcher(spark):
    rng = random.Random(3)
    names = ["a", "b", "src", "bc", "bd", "a.ts", "x1.js", "x.ts", "index.tsx", ".git", ".env", "ab", "a.b", "axxb", "é.ts", "c-1", "x["]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(300)} | set(names))
    d = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    for p in PATTERNS:
        got = [r.path for r in d.where(globs.matching(F.col("path"), [p])).collect()]
        assert sorted(got) == [x for x in paths if plain(p, x)], p
    got = {r.path for r in d.where(globs.matching(F.col("path"), ["**/*.ts", "src/**"], ["**/a*", "*/b/**"])).collect()}
    assert got == {x for x in paths if (plain("**/*.ts", x) or plain("src/**", x)) and not plain("**/a*", x) and not plain("*/b/**", x)}
    assert d.where(globs.matching(F.col("path"))).count() == len(paths)
    assert globs.alternatives("a{b,c{d,e}}f{,g}") == ["abf", "abfg", "acdf", "acdfg", "acef", "acefg"]


def test_first_paths_without_a_total_sort(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("p/"), F.md5(F.col("id").cast("string"))).alias("path"), "id")
    paths = sorted(r.path for r in rows.collect())
    for n in (0, 1, 150, 7_003, 19_999, 30_000):
        assert sorted(r.path for r in globs.first(rows, n, small=300).collect()) == paths[:n]
    same = spark.range(3000).select(F.lit("same").alias("path"))
    assert globs.first(same, 1200, small=100).count() == 1200
    assert globs.first(rows.limit(0), 5).count() == 0


def test_tree_source(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    files = {"a.py": b"x = 1\n", "src/B.TS": "é".encode(), "src/empty.js": b"", "src/deep/er/c.rs": b"\xff\xfe", "big.go": b"x" * (scan.MAX_BYTES + 1), "node_modules/no.js": b"1", "src/build/no.py": b"1", ".git/no.py": b"1", "readme.md": b"1", "src/locked.py": b"1"}
    for p, raw in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(raw)
    os.remove(root / "src/locked.py")
    os.symlink(root / "nowhere", root / "src/locked.py")  # a name that can't be read
    tree.register(spark)
    got = {r.path: r for r in spark.read.format("source_tree").option("partitionBytes", 100_000).load(str(root)).collect()}
    assert {p: (r.status, r.lang, r.text) for p, r in got.items() if p != "src/locked.py"} == {
        "a.py": ("ok", "python", "x = 1\n"), "src/B.TS": ("ok", "typescript", "é"), "src/empty.js": ("empty", "javascript", ""), "src/deep/er/c.rs": ("ok", "rust", "��"), "big.go": ("too large", "go", None),
    }
    assert got["big.go"].length == scan.MAX_BYTES + 1 and ("src/locked.py" not in got or got["src/locked.py"].status == "unreadable")
    assert spark.read.format("source_tree").load(f"file://{root}").where("status = 'ok'").count() == 3
    reader = tree.TreeReader({"path": str(root), "partitionBytes": "100000"})
    assert len(reader.partitions()) >= 4 and sum(len(p.files) for p in reader.partitions()) >= 5
    (tmp_path / "none").mkdir()
    assert spark.read.format("source_tree").load(str(tmp_path / "none")).count() == 0


def test_a_file_that_goes_after_it_was_listed_is_unreadable(tmp_path):
    reader = tree.TreeReader({"path": str(tmp_path)})
    assert [r[3] for r in reader.read(tree.Files([("gone.py", 5)]))] == ["unreadable"]

"""Manifests, roots and prefix rules on small trees."""

import duckdb
import pytest
from test_queries import value

from spandrel.operators import projects
from spandrel.plans import catalog

MANIFESTS = [
    ("package.json", '{"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"b": "2"}, "optionalDependencies": {"c": "3"}}'),
    ("py/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3"\nflask = "2"\n\n[tool.poetry.dev-dependencies]\npytest = { version = "8" }\n\n[project]\ndependencies = [\n "d>=1", "e"\n]\n'),
    ("py/requirements.txt", "# no\nflask==3\n\nf<2\n"),
    ("py/setup.py", "setup(install_requires=['g>1', \"h\"])"),
    ("rb/Gemfile", "gem 'rack', '1'\ngem 'lost'\n"),
    ("rb/Gemfile.lock", "GEM\n  rack (2.0)\n    inner (1)\n"),
    ("rb2/Gemfile", "gem 'rails'\n"),
    ("rs/Cargo.toml", '[package]\nname = "n"\n[dependencies]\nserde = "1"\n[build-dependencies]\ncc = { version = "2" }\n[lib]\nx = "1"\n'),
    ("php/composer.json", '{"require": {"V": "1"}, "require-dev": {"W": "2"}}'),
    ("cs/x.csproj", '<ItemGroup><PackageReference Include="J" Version="1" /><PackageReference Include="K"><Version>2</Version></PackageReference><PackageReference Include="L" /></ItemGroup>'),
    ("jv/pom.xml", "<dependencies><dependency><groupId>g</groupId><artifactId>art</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>bare</artifactId></dependency></dependencies>"),
    ("jv/build.gradle.kts", 'implementation("h:art:2")\n'),
    ("jv/src/main/java/module-info.java", "module m { requires java.sql; requires x.y; }"),
    ("broken/package.json", "{"),
    ("broken/tsconfig.json", None),
    ("other/readme.md", "gem 'no'"),
]


def frame(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


def test_declared_names_and_versions(spark):
    found = {}
    for r in projects.declared(frame(spark, MANIFESTS)).collect():
        found.setdefault((r.root, r.lang), {})[r.name] = r.version
    script = {"a": "1", "b": "2", "c": "3"}
    assert found == {
        ("", "typescript"): script, ("", "javascript"): script,
        ("py", "python"): {"flask": "flask==3", "pytest": "{ version = ", "d": "d>=1", "e": "e", "f": "f<2", "g": "g>1", "h": "h"},
        ("rb", "ruby"): {"rack": "2.0"}, ("rb2", "ruby"): {"rails": "latest"}, ("rs", "rust"): {"serde": "1", "cc": "{ version = "}, ("php", "php"): {"V": "1", "W": "2"},
        ("cs", "csharp"): {"J": "1", "K": "2", "L": "latest"}, ("jv", "java"): {"g:art": "1", "g:bare": "unknown", "h:art": "2", "module:java.sql": "", "module:x.y": ""},
    }


def test_nearest_roots_and_their_resolvers(spark):
    files = frame(spark, [(p,) for p, _ in MANIFESTS] + [("both/tsconfig.json",), ("both/package.json",), ("both/in/pom.xml",)], "path string")
    known = {r.root: r.lang for r in projects.roots(files).collect()}
    assert known == {"": "javascript", "py": "python", "rb": "ruby", "rb2": "ruby", "rs": "rust", "php": "php", "cs": "csharp", "jv": "java", "broken": "typescript", "both": "typescript", "both/in": "java"}
    folders = frame(spark, [("",), ("jv/src/main/java",), ("both/in/x/y",), ("both/inner",), ("rb/a",), ("rb",)], "here string")
    assert {r.here: r.root for r in projects.nearest(folders, projects.roots(files)).collect()} == {"": "", "jv/src/main/java": "jv", "both/in/x/y": "both/in", "both/inner": "both", "rb/a": "rb", "rb": "rb"}
    assert projects.nearest(folders, projects.roots(files.limit(0))).count() == 0


def test_aliases_namespaces_and_places(spark):
    manifests = [
        ("ts/tsconfig.json", '{\n// comment\n"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@/deep/*": ["../lib/*", "deep2/*"], "one": ["only.ts"], "pre*post": ["x/*.ts"],},}}'),
        ("ts/package.json", '{"dependencies": {"react": "1"}}'), ("php/composer.json", '{"autoload": {"psr-4": {"A\\\\": ["no"], "A\\\\B\\\\": "b/", "C\\\\": "c"}}, "require": {"V": "1"}}'),
        ("jv/pom.xml", "<dependency><groupId>g</groupId><artifactId>org.long</artifactId></dependency><dependency><groupId>g</groupId><artifactId>org</artifactId></dependency>"), ("jv/src/main/java/module-info.java", "requires m.n;"), ("rs/Cargo.toml", ""),
    ]
    files = [p for p, _ in manifests] + ["ts/src/a.ts", "ts/src/m.tsx", "ts/src/deep2/q.ts", "ts/lib/r/index.ts", "ts/src/only.ts", "ts/src/x/mid.ts", "ts/src/util/u.ts", "ts/src/w.ts", "php/b/K/L.php", "php/c/D.php", "php/c/Use/F.php", "jv/p/Q.java", "rs/s/n/mod.rs", "rs/s/k/k.rs", "rs/s/sym.rs", "free/x.py"]
    cases = [
        ("ts/src/a.ts", "@/m", "ts/src/m.tsx", False), ("ts/src/a.ts", "@/deep/q", "ts/src/deep2/q.ts", False), ("ts/src/a.ts", "@/deep/r", "ts/lib/r/index.ts", False), ("ts/src/a.ts", "one", "ts/src/only.ts", False),
        ("ts/src/a.ts", "premidpost", "ts/src/x/mid.ts", False), ("ts/src/a.ts", "util/u", "ts/src/util/u.ts", False), ("ts/src/util/u.ts", "../w.js", "ts/src/w.ts", False), ("ts/src/a.ts", "react", "react", True), ("ts/src/a.ts", "react/x", "react/x", True), ("ts/src/a.ts", "./gone", "./gone", True),
        ("php/x.php", "A\\B\\K\\L", "php/b/K/L.php", False), ("php/x.php", "C\\D", "php/c/D.php", False), ("php/x.php", "V\\X", "V\\X", True), ("php/x.php", "Z\\X", "Z\\X", False), ("php/x.php", "C\\Use", "php/c/Use/F.php", False),
        ("jv/A.java", "org.long.X", "g:org.long", True), ("jv/A.java", "m.n;", "m.n", True), ("jv/A.java", "x.p.Q", "jv/p/Q.java", False), ("jv/A.java", "x.Gone", "x.Gone", False),
        ("rs/s/x.rs", "n", "rs/s/n/mod.rs", False), ("rs/s/x.rs", "k", "rs/s/k/k.rs", False), ("rs/s/x.rs", "crate::z", "rs/s/sym.rs", False), ("rs/s/x.rs", "q", "q", True), ("free/y.py", "x", "x", None),
    ]
    symbols = lambda o: ["F"] if o == "C\\Use" else ["sym"] if o.startswith("crate") else []
    imports = spark.createDataFrame([(f, o, k, symbols(o), "x") for k, (f, o, _, _) in enumerate(cases)] + [(None, "a", 99, [], "x"), ("a", None, 98, [], "x")], "file string, origin string, ordinal int, symbols array<string>, path string")
    got = {r.ordinal: (r.resolved, r.is_external) for r in projects.resolve_projects(imports, frame(spark, [(f,) for f in files], "path string"), frame(spark, manifests)).collect()}
    assert got == {k: (to, out) for k, (_, _, to, out) in enumerate(cases)}


@pytest.mark.parametrize("name", ["project_imports"])
def test_all_eight_languages_at_the_next_size(spark, name):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    expected = c.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, "/root/testdata/sf0.01")
    rows = sorted(tuple(value(r[c]) for c in expected.columns) for r in got.collect())
    assert rows == sorted(tuple(map(value, r)) for r in expected.fetchall())
    assert len({r[expected.columns.index("lang")] for r in rows}) == 8

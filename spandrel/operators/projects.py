"""Import resolution in repositories with nested roots: each file goes by the nearest manifest above it, which picks one resolver; prefixes are matched by joins.

A prefix rule (a namespace, an alias with one wildcard, an artifact name) of a root meets the names that begin with it by an equi join: a name is cut at the lengths that its root's rules have. What a rule or a
language proposes becomes candidate paths with a rank; the best one that the file list has is the result. Roots, rules and dependencies are broadcast while they are few (``FEW``), else shuffled.

Rows whose file or origin is null are left out; a file below no root gets its origin back, with no resolver. Broken manifests make a root without dependencies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.resolve import folder, joined
from spandrel.operators.storage import written

# Resolvers in the order in which a root asks them, with the manifests that each takes.
MANIFESTS = [
    ("typescript", ["tsconfig.json"]),
    ("javascript", ["package.json"]),
    ("python", ["pyproject.toml", "requirements.txt", "setup.py"]),
    ("ruby", ["Gemfile", "Gemfile.lock"]),
    ("rust", ["Cargo.toml"]),
    ("php", ["composer.json"]),
    ("csharp", [".csproj"]),
    ("java", ["pom.xml", "build.gradle", "build.gradle.kts", "src/main/java/module-info.java"]),
]
# Patterns of declared names in manifests, and where a requirement's name ends.
GEM = r"gem\s+['\"]([^'\"]+)['\"](?:,\s*['\"]([^'\"]+)['\"])?"
LOCKED_GEM = r"(?m)^\s{2}([\w-]+) \((.+)\)"
GRADLE = r"['\"]([a-zA-Z0-9_.-]+:[a-zA-Z0-9_.-]+):?([a-zA-Z0-9_.-]*)['\"]"
REQUIRES = r"requires\s+([a-zA-Z0-9_.]+);"
INSTALL_REQUIRES = r"(?s)install_requires\s*=\s*\[(.*?)\]"
COMPARISON = "[<=>]"
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
FEW = 100_000
MODULE = "src/main/java/module-info.java"


def sized(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def manifest_root(path: Column) -> Column:
    """The folder for which a manifest speaks."""
    return F.when(path.endswith(MODULE), F.regexp_replace(path, rf"/?{MODULE}$", "")).otherwise(folder(path))


def manifest_lang(path: Column) -> Column:
    """Place in MANIFESTS of the resolver that takes this file, null if none does."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.lit(None).cast("int")
    for k, (_, names) in reversed(list(enumerate(MANIFESTS))):
        own = reduce(lambda a, b: a | b, [name.endswith(n) if n.startswith(".") else (path == n) | path.endswith("/" + n) if "/" in n else name == n for n in names])
        found = F.when(own, F.lit(k)).otherwise(found)
    return found


def roots(files: DataFrame) -> DataFrame:
    """root and lang: every folder with a manifest among ``files`` (path), and the first resolver that takes one."""
    path = F.col("path")
    names = F.array(*(F.lit(lang) for lang, _ in MANIFESTS))
    found = files.select(manifest_root(path).alias("root"), manifest_lang(path).alias("k")).where("k IS NOT NULL")
    return found.groupBy("root").agg(F.min("k").alias("k")).select("root", F.element_at(names, F.col("k") + 1).alias("lang"))


def ancestors(path: Column) -> Column:
    """A folder and all folders above it, up to the empty one."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest(folders: DataFrame, known: DataFrame) -> DataFrame:
    """here, root and lang: for each of ``folders`` (here) the deepest of the roots ``known`` at or above it."""
    up = folders.select("here").distinct().select("here", F.explode(ancestors(F.col("here"))).alias("root"))
    return up.join(sized(known), "root").groupBy("here").agg(F.max_by(F.struct("root", "lang"), F.length("root")).alias("r")).select("here", "r.*")


def _entries(names: Column, versions: Column | None = None, default: str = "latest") -> Column:
    versions = F.transform(names, lambda _: F.lit("")) if versions is None else versions
    return F.zip_with(names, versions, lambda n, v: F.named_struct(F.lit("name"), n, F.lit("version"), F.when(F.coalesce(v, F.lit("")) == "", F.lit(default)).otherwise(v)))


def _all(text: Column, pattern: str, *groups: int, default: str = "latest") -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return _entries(*found, default=default) if len(found) > 1 else _entries(found[0], default=default)


def _json(text: Column, *sections: str) -> Column:
    part = lambda s: F.from_json(F.get_json_object(text, f"$['{s}']"), "map<string,string>")
    return F.concat(*(F.coalesce(F.transform(F.map_entries(part(s)), lambda e: F.named_struct(F.lit("name"), e["key"], F.lit("version"), e["value"])), _none()) for s in sections))


def _toml(text: Column, *sections: str) -> Column:
    body = lambda s: F.regexp_extract(text, rf"(?ms)^\[{s}\][^\n]*\n(.*?)(?=^\[|\z)", 1)
    return F.concat(*(_all(body(s), r"(?m)^\s*[\"']?([\w.-]+)[\"']?\s*=\s*[\"']?([^\"'\n]*)", 1, 2) for s in sections))


def _listed(text: Column, pattern: str) -> Column:
    """Requirements in quotes inside what ``pattern`` captures; the name ends at a comparison."""
    every = F.regexp_extract_all(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ","), F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1))
    return _entries(F.transform(every, lambda x: F.trim(F.split(x, COMPARISON)[0])), every)


def _none() -> Column:
    return F.array().cast("array<struct<name:string,version:string>>")


def declared(manifests: DataFrame) -> DataFrame:
    """root, lang, name, version and ordinal of the dependencies that ``manifests`` (path, text) declare; of one name in several sections or files of a root the last in MANIFESTS and section order holds.

    Gemfile.lock replaces Gemfile. Java names are group:artifact, or modules, which begin with ``module:``.
    """
    path, text = F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    name = F.element_at(F.split(path, "/"), -1)
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    packages = F.regexp_extract_all(text, F.lit(r"(?s)<PackageReference\b[^>]*?Include=\"[^\"]+\"[^>]*?(?:/>|>.*?</PackageReference>)"), F.lit(0))
    poms = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>.*?</dependency>"), F.lit(0))
    one = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    first = lambda *options: F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))
    pair = lambda x: F.concat(one(x, r"<groupId>\s*([^<\s]+)"), F.lit(":"), one(x, r"<artifactId>\s*([^<\s]+)"))
    python = F.concat(F.filter(_toml(text, r"tool\.poetry\.dependencies"), lambda e: e["name"] != "python"), _toml(text, r"tool\.poetry\.dev-dependencies"), _listed(text, r"(?ms)^dependencies\s*=\s*\[(.*?)\]"), _listed(text, r"(?s)\[project\.optional-?[dD]ependencies\](.*?)(?:\n\[[a-z]|\z)"))
    found = (
        F.when(name == "package.json", _json(text, "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))
        .when(name == "composer.json", _json(text, "require", "require-dev"))
        .when(name == "pyproject.toml", python)
        .when(name == "requirements.txt", _entries(F.transform(lines, lambda x: F.trim(F.split(x, COMPARISON)[0])), lines))
        .when(name == "setup.py", _listed(text, INSTALL_REQUIRES))
        .when(name == "Gemfile", _all(text, GEM, 1, 2))
        .when(name == "Gemfile.lock", _all(F.regexp_extract(text, r"(?s)GEM.*", 0), LOCKED_GEM, 1, 2))
        .when(name == "Cargo.toml", _toml(text, "dependencies", "dev-dependencies", "build-dependencies"))
        .when(name.endswith(".csproj"), _entries(F.transform(packages, lambda x: one(x, r"Include=\"([^\"]+)\"")), F.transform(packages, lambda x: first(one(x, r"\bVersion=\"([^\"]+)\""), one(x, r"<Version>\s*([^<\s]+)")))))
        .when(name == "pom.xml", _entries(F.transform(poms, pair), F.transform(poms, lambda x: one(x, r"<version>\s*([^<\s]+)")), default="unknown"))
        .when(name.isin("build.gradle", "build.gradle.kts"), _all(text, GRADLE, 1, 2, default="unknown"))
        .when(path.endswith(MODULE), _entries(F.transform(F.regexp_extract_all(text, F.lit(REQUIRES), F.lit(1)), lambda x: F.concat(F.lit("module:"), x)), default=""))
    )
    order = F.array_position(F.array(*(F.lit(n) for _, ns in MANIFESTS for n in ns)), F.when(name.endswith(".csproj"), F.lit(".csproj")).when(path.endswith(MODULE), F.lit(MODULE)).otherwise(name))
    names = F.array(*(F.lit(lang) for lang, _ in MANIFESTS))
    # package.json speaks for both script resolvers
    langs = F.when(name == "package.json", F.array(F.lit("typescript"), F.lit("javascript"))).otherwise(F.array(F.element_at(names, manifest_lang(path) + 1)))
    rows = manifests.select(manifest_root(path).alias("root"), F.explode(langs).alias("lang"), order.alias("_file"), (name == "Gemfile.lock").alias("_lock"), found.alias("_found")).where("lang IS NOT NULL AND _found IS NOT NULL")
    locked = rows.where("_lock").select("root").distinct()
    rows = rows.where("_lock OR lang <> 'ruby'").unionByName(rows.where("NOT _lock AND lang = 'ruby'").join(locked, "root", "left_anti").select(*rows.columns))
    rows = rows.select("root", "lang", "_file", F.posexplode("_found").alias("_at", "e")).where("e.name <> ''")
    place = F.struct("_file", "_at")
    return rows.groupBy("root", "lang", F.col("e.name").alias("name")).agg(F.max_by("e.version", place).alias("version"), F.min(F.col("_file") * 1_000_000 + F.col("_at")).alias("ordinal"))


def rules(manifests: DataFrame) -> DataFrame:
    """Prefix rules of ``manifests`` (path, text): root, lang, prefix, suffix, wild, target (a path from the root, with * for what the wildcard matched) and place.

    PSR-4 prefixes of composer.json, and paths of tsconfig.json (comments and trailing commas allowed), whose targets go from baseUrl.
    """
    path, text = F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    named = lambda n: manifests.where((path == n) | path.endswith("/" + n))
    psr = named("composer.json").select(folder(path).alias("root"), F.posexplode(F.from_json(F.get_json_object(text, "$.autoload['psr-4']"), "map<string,string>")).alias("place", "prefix", "target"))
    psr = psr.select("root", F.lit("php").alias("lang"), "prefix", F.lit("").alias("suffix"), F.lit(True).alias("wild"), F.concat(F.regexp_replace("target", "/+$", ""), F.lit("/*")).alias("target"), "place")
    config = F.from_json(F.regexp_replace(text, r",(\s*[}\]])", "$1"), "compilerOptions struct<baseUrl: string, paths: map<string,array<string>>>", {"allowComments": "true"})
    ts = named("tsconfig.json").select(folder(path).alias("root"), config["compilerOptions"].alias("c")).select("root", F.coalesce("c.baseUrl", F.lit(".")).alias("base"), F.posexplode("c.paths").alias("place", "pattern", "targets"))
    ts = ts.select("root", "base", "pattern", "place", F.posexplode("targets").alias("k", "target"))
    star = F.col("pattern").contains("*")
    ts = ts.select("root", F.lit("typescript").alias("lang"), F.substring_index("pattern", "*", 1).alias("prefix"), F.when(star, F.substring_index("pattern", "*", -1)).otherwise("").alias("suffix"), star.alias("wild"), F.concat_ws("/", "base", "target").alias("target"), (F.col("place") * 1000 + F.col("k")).alias("place"))
    return psr.unionByName(ts)


def base_urls(manifests: DataFrame) -> DataFrame:
    """root and base of the tsconfig.json files that set baseUrl."""
    path, text = F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    config = F.from_json(F.regexp_replace(text, r",(\s*[}\]])", "$1"), "compilerOptions struct<baseUrl: string>", {"allowComments": "true"})
    return manifests.where((path == "tsconfig.json") | path.endswith("/tsconfig.json")).select(folder(path).alias("root"), config["compilerOptions"]["baseUrl"].alias("base")).where("base IS NOT NULL")


def prefixed(names: DataFrame, table: DataFrame) -> DataFrame:
    """``names`` (root, lang, name, ...) joined with every rule of ``table`` (root, lang, prefix, ...) whose prefix the name begins with."""
    lengths = table.groupBy("root", "lang").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    cut = names.join(sized(written(lengths)), ["root", "lang"]).select("*", F.explode(F.filter("_lengths", lambda n: n <= F.length("name"))).alias("_n")).drop("_lengths")
    return cut.withColumn("prefix", F.substr("name", F.lit(1), F.col("_n"))).drop("_n").join(sized(table), ["root", "lang", "prefix"])


def _proposed(lang: str, here: Column, root: Column, name: Column) -> Column | None:
    """Candidate paths by a language's own rule, best first; names are as module() gives them."""
    dotted = F.regexp_replace(name, r"\.", "/")
    ends = lambda base, endings: F.array(*(F.concat(base, F.lit(e)) for e in endings))
    if lang == "typescript":
        local = joined(here, name)
        return F.when(name.startswith("."), F.concat(ends(local, SCRIPT_ENDINGS), F.when(name.endswith(".js"), ends(F.regexp_replace(local, r"\.js$", ""), (".ts", ".tsx"))).otherwise(F.array().cast("array<string>"))))
    if lang == "python":
        return F.array(F.concat(joined(here, dotted), F.lit(".py")))
    if lang == "ruby":
        return F.array(F.concat(joined(here, F.when(name.startswith("."), name).otherwise(dotted)), F.lit(".rb")))
    if lang == "rust":
        inner = F.regexp_replace(name, "::", "/")
        return F.array(F.concat(joined(here, inner), F.lit(".rs")), F.concat(joined(here, inner), F.lit("/mod.rs")), F.concat(joined(here, F.concat(inner, F.lit("/"), inner)), F.lit(".rs")))
    if lang == "csharp":
        return F.array(F.concat(joined(root, dotted), F.lit(".cs")))
    if lang == "java":
        return F.array(F.concat(joined(here, F.regexp_replace(dotted, "^[^/]*/", "")), F.lit(".java")))
    return None


def module(lang: Column, origin: Column, symbols: Column) -> Column:
    """The name that a resolver looks for."""
    return (
        F.when(lang == "python", F.regexp_replace(F.regexp_replace(origin, r"\.py$", ""), "/", "."))
        .when((lang == "rust") & origin.startswith("crate"), F.array_join(symbols, "::"))
        .when(lang == "java", F.regexp_replace(origin, ";", ""))
        .otherwise(origin)
    )


def resolve_projects(imports: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """file, origin, ordinal, root, lang (of the resolver), resolved and is_external of every row of ``imports`` (file, origin, ordinal, symbols).

    ``files`` (path) are all files of the repositories, ``manifests`` (path, text) those that say something. A name that its root declares is external; else the best candidate path that exists
    is the result; else the name itself, external where the language takes unknown names for packages.
    """
    known = written(roots(files))
    own = imports.where("file IS NOT NULL AND origin IS NOT NULL").select("file", "origin", "ordinal", "symbols").withColumn("here", folder(F.col("file")))
    placed = own.join(nearest(own, known), "here", "left").withColumn("name", module(F.col("lang"), F.col("origin"), F.col("symbols")))
    placed = written(placed.withColumn("no", F.monotonically_increasing_id()))
    has = written(declared(manifests))
    # Declared names: the name itself, its first part, or for Java an artifact that begins it.
    head = F.when(F.col("lang") == "python", F.split("name", r"\.")[0]).when(F.col("lang") == "php", F.split("name", r"\\")[0]).when(F.col("lang") == "java", F.concat(F.lit("module:"), F.col("name"))).otherwise(F.col("name"))
    by_name = placed.withColumn("head", head).join(sized(written(has.select("root", "lang", F.col("name").alias("head")))), ["root", "lang", "head"]).select("no", F.col("name").alias("resolved"), F.lit(0).alias("rank"))
    artifacts = written(has.where("lang = 'java' AND name NOT LIKE 'module:%'").select("root", "lang", F.split("name", ":")[1].alias("prefix"), F.col("name").alias("key"), "ordinal"))
    by_artifact = prefixed(placed.where("lang = 'java'").select("no", "root", "lang", "name"), artifacts).groupBy("no").agg(F.min_by("key", "ordinal").alias("resolved")).select("no", "resolved", F.lit(1).alias("rank"))
    external = by_name.unionAll(by_artifact).groupBy("no").agg(F.min_by("resolved", "rank").alias("package"))
    # Candidates: rules of the longest prefix first, then the language's own places.
    matched = prefixed(placed.select("no", "root", "lang", "name", "symbols"), written(rules(manifests)))
    middle = F.substr("name", F.length("prefix") + 1, F.length("name") - F.length("prefix") - F.length("suffix"))
    matched = matched.where(F.when(F.col("wild"), F.col("name").endswith(F.col("suffix")) & (F.length("name") >= F.length("prefix") + F.length("suffix"))).otherwise(F.col("name") == F.col("prefix")))
    best = matched.groupBy("no").agg(F.min(F.struct(F.col("wild"), -F.length("prefix"))).alias("_best"))
    # of aliases only the best pattern is tried, of namespaces all
    matched = matched.join(best, "no").where((F.col("lang") == "php") | (F.struct(F.col("wild"), -F.length("prefix")) == F.col("_best")))
    plain = F.replace(F.col("target"), F.lit("*"), F.when(F.col("lang") == "php", F.regexp_replace(middle, r"\\", "/")).otherwise(middle))
    base = joined(F.col("root"), plain)
    tails = F.when(F.col("lang") == "php", F.array(F.lit(".php"), F.concat(F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("/"), s)), ""), F.lit(".php")))).otherwise(F.array(*map(F.lit, SCRIPT_ENDINGS)))
    by_rule = matched.select("no", (-F.length("prefix") * 10_000_000 + F.col("place") * 100).alias("_r"), base.alias("base"), F.posexplode(tails).alias("k", "tail")).select("no", (F.col("_r") + F.col("k")).cast("long").alias("rank"), F.concat("base", "tail").alias("path"))
    from_base = placed.where("lang = 'typescript' AND NOT name LIKE '.%'").join(sized(written(base_urls(manifests))), "root").select("no", joined(F.col("root"), F.concat_ws("/", "base", "name")).alias("base"), F.posexplode(F.array(*map(F.lit, SCRIPT_ENDINGS))).alias("k", "tail"))
    candidates = [by_rule, from_base.select("no", F.col("k").cast("long").alias("rank"), F.concat("base", "tail").alias("path"))]
    for lang, _ in MANIFESTS:
        paths = _proposed(lang, F.col("here"), F.col("root"), F.col("name"))
        if paths is not None:
            candidates.append(placed.where(F.col("lang") == lang).select("no", F.posexplode(paths).alias("k", "path")).select("no", (F.col("k") + 100).cast("long").alias("rank"), "path"))
    hits = reduce(DataFrame.unionByName, candidates).join(files.select("path").distinct(), "path").groupBy("no").agg(F.min_by("path", "rank").alias("path"))
    done = placed.join(external, "no", "left").join(hits, "no", "left")
    script = F.when(F.col("lang") == "javascript", joined(F.col("here"), F.col("name")))
    unknown = F.col("lang").isin("typescript", "rust", "csharp")
    return done.select("file", "origin", "ordinal", "root", "lang", F.coalesce("package", script, "path", "name", "origin").alias("resolved"), F.when(F.col("package").isNotNull(), True).when(F.col("lang") == "javascript", False).when(F.col("path").isNotNull(), False).otherwise(unknown).alias("is_external"))

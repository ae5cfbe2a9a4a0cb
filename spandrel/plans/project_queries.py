"""Resolution of imports in a tree of nested projects that the documents' numbers lay out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import projects
from spandrel.plans.registry import query
from spandrel.sources.tables import read

ENDINGS = ("ts", "js", "py", "rb", "rs", "php", "cs", "java")
# Origins and manifests: {j} is another document's number, {g} the group, {d} a package's number, {s} the folder of the sources from the root.
LOCAL = ("./m{j}", "./m{j}", "m{j}", "m{j}", "m{j}", "App\\m{j}", "src.m{j}", "p.m{j}")
MAPPED = ("@m/m{j}", "dep{d}", "dep{d}.sub", "dep{d}", "dep{d}", "App\\Deep\\m{j}", "dep{d}", "art{g}.X")
TEXTS = (
    ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", /* aliases */ "paths": {"@m/m1*": ["alt/*"], "@m/*": ["lib/*", "{s}/*"],}}}'),
    ("package.json", '{"dependencies": {"dep{d}": "1"}}'),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "dep{d}>=1",\n]\n'),
    ("Gemfile", "source 'x'\ngem 'dep{d}', '~> 1'\n"),
    ("Cargo.toml", '[package]\nname = "x"\n\n[dependencies]\ndep{d} = "1"\n'),
    ("composer.json", '{"autoload": {"psr-4": {"App\\\\": "{s}/", "App\\\\Deep\\\\": "{s}"}}}'),
    ("x.csproj", '<Project><ItemGroup><PackageReference Include="dep{d}"><Version>1</Version></PackageReference></ItemGroup></Project>'),
    ("build.gradle", "implementation 'grp:art{g}:1.0'"),
)


def listed(values):
    """A list of strings in SQL."""
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, g (group of forty), k (folder and kind of file) and r (resolver) of each document; every other group has one root for all its folders."""
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(i.alias("i"), F.floor(i / 40).alias("g"), (i % 8).alias("k"))
    return d.withColumn("r", F.when(F.col("g") % 2 == 0, F.col("k")).otherwise(F.col("g") % 8)).withColumn("j", F.col("i") * 7 % 40 + F.col("g") * 40)


TREE_SQL = f"""
d AS (SELECT doc_id AS i, doc_id // 40 AS g, doc_id % 8 AS k, doc_id * 7 % 40 + doc_id // 40 * 40 AS j FROM documents),
t AS (SELECT *, CASE WHEN g % 2 = 0 THEN k ELSE g % 8 END AS r, j IN (SELECT doc_id FROM documents) AS found, 'g' || g || '/' || k || '/src/' AS here FROM d),
x AS (SELECT *, found AND j % 8 = k AS beside, {listed(ENDINGS)}[k + 1] AS ending, CASE WHEN g % 2 = 0 THEN 'g' || g || '/' || k ELSE 'g' || g END AS root FROM t)
"""


@query(f"""WITH {TREE_SQL},
a AS (SELECT *, 0 AS n, replace({listed(LOCAL)}[r + 1], '{{j}}', j::VARCHAR) AS origin FROM x
  UNION ALL SELECT *, 1, replace(replace(replace({listed(MAPPED)}[r + 1], '{{j}}', j::VARCHAR), '{{d}}', (g % 5)::VARCHAR), '{{g}}', g::VARCHAR) FROM x UNION ALL SELECT *, 2, 'lost' || i FROM x),
b AS (SELECT *, CASE
  WHEN n = 0 AND r = 0 AND beside AND k < 2 THEN here || 'm' || j || '.' || ending
  WHEN n = 0 AND r IN (2, 3, 4, 7) AND beside AND k = r THEN here || 'm' || j || '.' || ending
  WHEN n = 0 AND r = 6 AND beside AND g % 2 = 0 THEN here || 'm' || j || '.cs'
  WHEN n < 2 AND r = 5 AND found AND j % 8 = 5 THEN 'g' || g || '/5/src/m' || j || '.php'
  WHEN n = 1 AND r = 0 AND found AND j % 8 = 0 AND j::VARCHAR NOT LIKE '1%' THEN 'g' || g || '/0/src/m' || j || '.ts' END AS path FROM a)
SELECT here || 'm' || i || '.' || ending AS file, origin, root, {listed([lang for lang, _ in projects.MANIFESTS])}[r + 1] AS lang,
  CASE WHEN n = 1 AND r = 7 THEN 'grp:art' || g WHEN r = 1 AND n = 0 THEN here || 'm' || j WHEN r = 1 AND n = 2 THEN here || origin ELSE coalesce(path, origin) END AS resolved,
  CASE WHEN n = 1 AND r NOT IN (0, 5) THEN true WHEN path IS NOT NULL THEN false ELSE r IN (0, 4, 6) END AS is_external
FROM b""")
def project_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three imports of each file: of a neighbour, by an alias, prefix or package, and of what does not exist."""
    tree = project_tree(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("g"), text("g"), F.lit("/"), text("k"), F.lit("/src/m"), text("i"), F.lit("."), pick(ENDINGS, F.col("k")))
    root = F.concat(F.lit("g"), text("g"), F.when(F.col("g") % 2 == 0, F.concat(F.lit("/"), text("k"))).otherwise(""))
    source = F.when(F.col("g") % 2 == 0, F.lit("src")).otherwise(F.concat(text("r"), F.lit("/src")))
    values = {"{j}": text("j"), "{d}": (F.col("g") % 5).cast("string"), "{g}": text("g"), "{s}": source}
    filled = lambda c: reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), kv[1]), values.items(), c)
    origins = F.array(filled(pick(LOCAL, F.col("r"))), filled(pick(MAPPED, F.col("r"))), F.concat(F.lit("lost"), text("i")))
    imports = tree.select(path.alias("file"), F.posexplode(origins).alias("ordinal", "origin"), F.array().cast("array<string>").alias("symbols"))
    manifests = tree.select(F.concat(root, F.lit("/"), pick([n for n, _ in TEXTS], F.col("r"))).alias("path"), filled(pick([t for _, t in TEXTS], F.col("r"))).alias("text"))
    manifests = manifests.groupBy("path").agg(F.min("text").alias("text"))
    files = tree.select(path.alias("path")).union(manifests.select("path"))
    return projects.resolve_projects(imports, files, manifests).select("file", "origin", "root", "lang", "resolved", "is_external")

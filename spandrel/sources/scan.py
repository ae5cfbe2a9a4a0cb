"""Source trees as tables: files, languages, manifests, import candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.scalar import extension

# Language, extensions, constructor name, word for the own object, comment prefixes.
LANGUAGES = [
    ("typescript", [".ts", ".tsx"], "constructor", "this", ["//", "/*", "*/", "*"]),
    ("javascript", [".js", ".jsx"], "constructor", "this", ["//", "/*", "*/", "*"]),
    ("python", [".py"], "__init__", "self", ["#"]),
    ("java", [".java"], "constructor", "this", ["//", "/*", "*/", "*"]),
    ("go", [".go"], "", "", ["//", "/*", "*/", "*"]),
    ("ruby", [".rb"], "initialize", "self", ["#"]),
    ("php", [".php"], "__construct", "$this", ["//", "/*", "*/", "*"]),
    ("csharp", [".cs"], "constructor", "this", ["//", "/*", "*/", "*"]),
    ("rust", [".rs"], "", "self", ["//", "/*", "*/", "*"]),
]
# Folders that are not scanned.
SKIPPED = ("node_modules", "dist", "build", "coverage", ".git", ".vscode")
MAX_BYTES = 5 * 1024 * 1024


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "lang string, extensions array<string>, constructor string, self string, comments array<string>")


def with_language(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with lang, null if no language has the extension; the nine rows are broadcast."""
    by = languages(files.sparkSession).select("lang", F.explode("extensions").alias("_ext"))
    return files.withColumn("_ext", extension("path")).join(F.broadcast(by), "_ext", "left").drop("_ext")


def is_source_path(path: Column) -> Column:
    names = "|".join(x.replace(".", r"\.") for x in SKIPPED)
    return ~path.rlike(rf"(^|/)({names})(/|$)") & extension(path).isin([e for _, es, *_ in LANGUAGES for e in es])


def below(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``; skip lists and keywords look at that alone."""
    at = F.locate(root.split("://")[-1].removeprefix("file:").rstrip("/") + "/", path)
    return F.when(at > 0, F.substr(path, at + len(root.split("://")[-1].removeprefix("file:").rstrip("/")) + 1)).otherwise(path)


def matches_keywords(path: Column, keywords: list[str]) -> Column:
    """Whether the path contains one of the keywords; no keywords let all pass."""
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: path.contains(k)) if keywords else F.lit(True)


def source_files(spark: SparkSession, root: str, keywords: list[str] | None = None, snapshot: str = "head") -> DataFrame:
    """snapshot, path, lang, length and text of the source files under ``root``; text is null for too large ones. Spark's reader leaves out
    files without a byte.

    Paths and lengths are filtered before any content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.where(is_source_path(below(F.col("path"), root)) & matches_keywords(below(F.col("path"), root), keywords or []))
    text = F.when(F.col("length") <= MAX_BYTES, F.decode("content", "UTF-8"))
    return with_language(kept.select(F.lit(snapshot).alias("snapshot"), "path", "length", text.alias("text")))


def directory_size(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(~below(F.col("path"), root).rlike(r"(^|/)\.git/")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as Parquet, edges by type."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def dependencies(manifests: DataFrame) -> DataFrame:
    """path and dependency of manifest files (path, text): package.json, requirements.txt, pyproject.toml, Gemfile, Cargo.toml, composer.json, pom.xml, .csproj."""
    name, text = F.element_at(F.split("path", "/"), -1), F.col("text")
    json_keys = lambda *fields: F.array_distinct(F.flatten(F.array_compact(F.array(*(F.map_keys(F.from_json(F.get_json_object(text, f"$.{f}"), "map<string,string>")) for f in fields)))))
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    section = F.regexp_extract(text, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1)
    found = (
        F.when(name == "package.json", json_keys("dependencies", "devDependencies", "peerDependencies"))
        .when(name == "composer.json", json_keys("require", "require-dev"))
        .when(name == "requirements.txt", every(r"(?m)^\s*([A-Za-z0-9_.-]+)"))
        .when(name == "pyproject.toml", F.array_distinct(F.regexp_extract_all(F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([A-Za-z0-9_.-]+)"), F.lit(1))))
        .when(name == "Cargo.toml", F.array_distinct(F.regexp_extract_all(section, F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="), F.lit(1))))
        .when(name == "Gemfile", every(r"(?m)^\s*gem\s+[\"']([^\"']+)"))
        .when(name == "Gemfile.lock", every(r"(?m)^ {4}([A-Za-z0-9_.-]+) \("))
        .when(name == "pom.xml", every(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)"))
        .when(name.endswith(".csproj"), every(r"PackageReference\s+Include=\"([^\"]+)\""))
    )
    return manifests.select("path", F.explode(found).alias("dependency"))

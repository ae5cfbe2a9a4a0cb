"""Imports to files: candidate paths joined with the file list, the best rank wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts that the imports of one package are dealt into.
SALTS = 32


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined(base: Column, relative: Column) -> Column:
    """POSIX join with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(base.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))


def candidates(lang: Column, file: Column, origin: Column) -> Column:
    """Paths that an import may mean, best first."""
    here = folder(file)
    dotted = F.regexp_replace(origin, r"\.", "/")
    script = F.when(origin.startswith("."), joined(here, origin)).otherwise(origin)
    # A lambda's variable, so that the base is worked out once for all endings.
    endings = lambda base, ends: F.element_at(F.transform(F.array(base), lambda b: F.array(*(F.concat(b, F.lit(e)) for e in ends))), 1)
    return (
        F.when(lang.isin("typescript", "javascript"), endings(script, ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")))
        .when(lang == "python", endings(joined(here, dotted), (".py", "/__init__.py")))
        .when(lang == "java", F.array(joined(here, F.concat(F.regexp_replace(dotted, "^[^/]*/", ""), F.lit(".java")))))
        .when(lang == "csharp", F.array(F.concat(dotted, F.lit(".cs"))))
        .when(lang == "php", F.array(joined(here, F.concat(F.regexp_replace(origin, r"\\", "/"), F.lit(".php"))), F.concat(F.regexp_replace(F.regexp_replace(origin, r"\\", "/"), "^/", ""), F.lit(".php"))))
        .when(lang == "rust", endings(joined(here, F.regexp_replace(F.regexp_replace(origin, "^(crate|self)::", ""), "::", "/")), (".rs", "/mod.rs")))
        .when(lang == "ruby", F.array(F.concat(joined(here, origin), F.lit(".rb"))))
        .otherwise(F.array().cast("array<string>"))
    )


def declared(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``imports`` with _dep: true if a dependency declares their package, else null. Relative imports name no package, and those of a frequent
    one are dealt into SALTS parts, so that no task takes them all."""
    i = imports.withColumn("_head", F.nullif(F.regexp_extract("origin", r"^(@[^/]+/[^/]+|[^./\\:]+)", 1), F.lit("")))
    i = i.withColumn("_salt", F.when(F.col("_head").isNull(), F.hash("file", "ordinal")).otherwise(F.pmod(F.hash("file", "ordinal"), F.lit(SALTS))))
    known = dependencies.select(F.col("dependency").alias("_head")).distinct().select("_head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_dep"))
    return i.join(known, ["_head", "_salt"], "left").drop("_head", "_salt")


def resolve(imports: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """imports (file, lang, origin, ordinal) with resolved (a path of ``files``, else the origin) and is_external.

    A declared dependency is external and has no path; so is whatever no candidate finds, except a relative import.
    """
    i = declared(imports, dependencies)
    tried = i.where("_dep IS NULL").select("file", "origin", "ordinal", F.posexplode(candidates(F.col("lang"), F.col("file"), F.col("origin"))).alias("_rank", "_path"))
    hits = tried.join(files.select(F.col("path").alias("_path")).distinct(), "_path").groupBy("file", "origin", "ordinal").agg(F.min_by("_path", "_rank").alias("_path"))
    out = i.join(hits, ["file", "origin", "ordinal"], "left")
    return out.select("file", "lang", "origin", "ordinal", F.coalesce("_path", "origin").alias("resolved"), (F.col("_path").isNull() & (F.col("_dep").isNotNull() | ~F.col("origin").rlike(r"^[./]"))).alias("is_external"))

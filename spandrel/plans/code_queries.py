"""Parsing, validation, import resolution and graph building over sources made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import graph, resolve
from spandrel.operators.storage import written
from spandrel.plans.registry import query
from spandrel.sources import parse, scan
from spandrel.sources.tables import read


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each document: a class with a method that calls another, and a function."""
    n = F.col("doc_id").cast("string")
    cls = F.concat(F.lit("C"), (F.col("doc_id") % 7).cast("string"))
    text = F.concat(F.lit("import os\n\nclass "), cls, F.lit("(Base):\n    def m"), n, F.lit("(self, a: int) -> str:\n        return self.other(helper(a))\n\n    def other(self, b):\n        return b\n\ndef helper(a):\n    return a\n"))
    return scan.with_language(read(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), n, F.lit(".py")).alias("path"), text.alias("text")))


@query("""
WITH d AS (SELECT doc_id, 'src/f' || doc_id || '.py' AS file, 'C' || doc_id % 7 AS c FROM documents)
SELECT file, 'm' || doc_id AS name, c AS class_name, 'self,a: int' AS params, 'str' AS returns, 4 AS start_line, 5 AS end_line FROM d
UNION ALL SELECT file, 'other', c, 'self,b', '', 7, 8 FROM d UNION ALL SELECT file, 'helper', '', 'a', '', 10, 11 FROM d
""")
def extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.parsed(python_sources(spark, sf_dir)).where("kind = 'function'")
    return found.select("file", "name", "class_name", F.array_join("params", ",").alias("params"), "returns", "start_line", "end_line")


@query("""
WITH d AS (SELECT doc_id, 'src/f' || doc_id || '.py' AS file, 'C' || doc_id % 7 AS c FROM documents)
SELECT file, c AS src, 'm' || doc_id AS dst, 'HAS_METHOD' AS type FROM d UNION ALL SELECT file, c, 'other', 'HAS_METHOD' FROM d
UNION ALL SELECT file, 'm' || doc_id, 'other', 'CALLS' FROM d UNION ALL SELECT file, 'm' || doc_id, 'helper', 'CALLS' FROM d
""")
def enrich_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source text to typed edges."""
    rows = written(parse.parsed(python_sources(spark, sf_dir)))
    functions = rows.where("kind = 'function'").select("id", "name", "file", "class_name", "ordinal")
    types = rows.where("kind = 'type'").select("id", "name", "file", F.lit("CLASS").alias("kind"), "extends", "implements", "ordinal")
    calls = rows.where("kind = 'call'").select(F.col("owner_id").alias("function_id"), F.col("name").alias("callee"), F.col("file").alias("target_file"), "caller", "ordinal")
    imports = rows.where("kind = 'import'").select("file", F.col("name").alias("symbol"), F.col("origin").alias("resolved"), "ordinal")
    nodes, edges = graph.enrich(functions, types, calls, imports)
    a, b = nodes.select(F.col("id").alias("src"), "path", F.col("name").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("path").alias("file"), F.col("a").alias("src"), F.col("b").alias("dst"), "type")


@query("SELECT doc_id, doc_id % 3 <> 0 AS is_valid, CASE WHEN doc_id % 3 <> 0 THEN 'VALID' ELSE 'SYNTAX_ERROR' END AS status FROM documents")
def validate_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text is broken."""
    text = F.when(F.col("doc_id") % 3 == 0, "def f(:\n").when(F.col("doc_id") % 3 == 1, "def f():\n    return 1\n").otherwise("f(a[1], {b: ')'});")
    lang = F.when(F.col("doc_id") % 3 == 2, "typescript").otherwise("python")
    d = read(spark, sf_dir, "documents").select("doc_id", parse.validate(lang, F.base64(text.cast("binary"))).alias("v"))
    return d.select("doc_id", "v.is_valid", "v.status")


@query("""
SELECT 'src/a' || page_id || '.ts' AS file, origin, CASE origin WHEN './b' THEN 'src/b.ts' WHEN '../lib' THEN 'lib/index.ts' ELSE origin END AS resolved, origin IN ('react', 'lost') AS is_external
FROM pages, (VALUES ('./b'), ('../lib'), ('react'), ('lost'), ('./gone')) t(origin)
""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = read(spark, sf_dir, "pages").select(F.concat(F.lit("src/a"), F.col("page_id").cast("string"), F.lit(".ts")).alias("file"), F.lit("typescript").alias("lang"), F.explode(F.array(*map(F.lit, ("./b", "../lib", "react", "lost", "./gone")))).alias("origin"), F.lit(0).alias("ordinal"))
    files = spark.createDataFrame([("src/b.ts",), ("src/b.js",), ("lib/index.ts",)], "path string")
    manifest = spark.createDataFrame([("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}')], "path string, text string")
    return resolve.resolve(imports, files, scan.dependencies(manifest)).select("file", "origin", "resolved", "is_external")


@query("SELECT page_id, lang FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' END AS lang FROM pages)")
def language_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".py", ".TSX", ".rs", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return scan.with_language(read(spark, sf_dir, "pages").select("page_id", F.concat("url", ext).alias("path"))).select("page_id", "lang")


# A small source file in each language; N stands for the document's number. Comments and strings hold declarations that do not count.
TEXTS = {
    "typescript": """import { B as C } from './b';
// class Fake { no() {} }
type PN = { a: string; b: number };
export class TN<T> extends Base implements I {
  private size: number = 1;
  constructor(private readonly b: Store) { super("function no() {}"); }
  async run(x: Map<string, number>): Promise<void> {
    this.b.go(helper(x));
  }
}
export const helper = (q: string): number => { return other(q); };
""",
    "javascript": """const fs = require("fs");
/* function no() {} */
class TN extends Base {
  run(x) { return this.stop(x); }
  stop(x) { fs.a(x).b(); }
}
function helper(x) { return x; }
""",
    "java": """import java.util.List;
// class Fake {}
public class TN extends Base implements I {
  private final Store b;
  public TN(Store b) { this.b = b; }
  public List<String> run(int a) { return this.b.go(helper(a)); }
  int helper(int a) { return a; }
}
enum EN { RED, GREEN }
""",
    "csharp": """using System.Text;
namespace N {
  public class TN : Base {
    public int Size { get; set; }
    public int Run(int a) { return this.Helper(a); }
    int Helper(int a) => a + One();
  }
}
""",
    "rust": """use crate::b::C;
pub struct TN { size: i32 }
trait Go { fn go(&self, a: i32) -> i32; }
impl Go for TN { fn go(&self, a: i32) -> i32 { helper(a) } }
fn helper(a: i32) -> i32 { a }
""",
    "php": """<?php
use App\\B;
class TN extends Base implements I {
  private int $size = 1;
  public function run(int $a): string { return $this->helper($a); }
  public function helper(int $a): string { return "x"; } # function no() {}
}
""",
    "ruby": """require 'json'
# class Fake
class TN < Base
  attr_reader :size
  def run(a)
    if a
      self.helper(a)
    end
  end
  def helper(a)
    a
  end
end
""",
}
ENDINGS = {"typescript": "ts", "javascript": "js", "java": "java", "csharp": "cs", "rust": "rs", "php": "php", "ruby": "rb"}
# What each text holds: kind, name, class or kind of type, and details.
FOUND = [
    ("typescript", "import", "B", "./b", "C"), ("typescript", "type", "PN", "TYPE_ALIAS", "a=string;b=number"),
    ("typescript", "type", "TN", "CLASS", "constructor=(private readonly b: Store):unknown;run=(x: Map<string, number>):Promise<void>;size=number"),
    ("typescript", "function", "constructor", "TN", "private readonly b: Store"), ("typescript", "function", "run", "TN", "x: Map<string, number>"), ("typescript", "function", "helper", "", "q: string"),
    ("typescript", "call", "go", "Store", ""), ("typescript", "call", "helper", "", ""), ("typescript", "call", "other", "", ""),
    ("javascript", "import", "*", "fs", "fs"), ("javascript", "type", "TN", "CLASS", "run=(x):unknown;stop=(x):unknown"),
    ("javascript", "function", "run", "TN", "x"), ("javascript", "function", "stop", "TN", "x"), ("javascript", "function", "helper", "", "x"), ("javascript", "call", "stop", "TN", ""), ("javascript", "call", "b", "fs", ""),
    ("java", "import", "*", "java.util.List", ""), ("java", "type", "TN", "CLASS", "TN=(Store b):unknown;b=Store;helper=(int a):int;run=(int a):List<String>"), ("java", "type", "EN", "ENUM", "GREEN=EN;RED=EN"),
    ("java", "function", "TN", "TN", "Store b"), ("java", "function", "run", "TN", "int a"), ("java", "function", "helper", "TN", "int a"), ("java", "call", "go", "Store", ""), ("java", "call", "helper", "", ""),
    ("csharp", "import", "*", "System.Text", ""), ("csharp", "type", "TN", "CLASS", "Helper=(int a):int;Run=(int a):int;Size=int"), ("csharp", "function", "Run", "TN", "int a"), ("csharp", "function", "Helper", "TN", "int a"),
    ("csharp", "call", "Helper", "TN", ""), ("csharp", "call", "One", "", ""),
    ("rust", "import", "*", "crate::b::C", ""), ("rust", "type", "TN", "CLASS", "size=i32"), ("rust", "type", "Go", "INTERFACE", "go=(&self, a: i32):i32"), ("rust", "type", "TN", "CLASS", "go=(&self, a: i32):i32"),
    ("rust", "function", "go", "Go", "&self|a: i32"), ("rust", "function", "go", "TN", "&self|a: i32"), ("rust", "function", "helper", "", "a: i32"), ("rust", "call", "helper", "", ""),
    ("php", "import", "*", "App\\B", ""), ("php", "type", "TN", "CLASS", "helper=(int $a):string;run=(int $a):string;size=int"), ("php", "function", "run", "TN", "int $a"), ("php", "function", "helper", "TN", "int $a"), ("php", "call", "helper", "TN", ""),
    ("ruby", "import", "*", "json", ""), ("ruby", "type", "TN", "CLASS", "helper=(a):unknown;run=(a):unknown;size=unknown"), ("ruby", "function", "run", "TN", "a"), ("ruby", "function", "helper", "TN", "a"), ("ruby", "call", "helper", "TN", ""),
]


def numbered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, in turn in each language."""
    at = (F.col("doc_id") % len(TEXTS) + 1).cast("int")
    n = F.col("doc_id").cast("string")
    text, ending = (F.element_at(F.array(*map(F.lit, x)), at) for x in (TEXTS.values(), [ENDINGS[k] for k in TEXTS]))
    numbered = F.regexp_replace(text, r"\b([TPE])N\b", F.concat(F.lit("$1"), n))
    return scan.with_language(read(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), n, F.lit("."), ending).alias("path"), numbered.alias("text")))


FOUND_SQL = ", ".join("(" + ", ".join([str(list(TEXTS).index(lang)), *("'" + x.replace("'", "''") + "'" for x in rest), f"'{ENDINGS[lang]}'"]) + ")" for lang, *rest in FOUND)


@query(f"""
SELECT 'src/f' || doc_id || '.' || ending AS file, kind, regexp_replace(name, '^([TPE])N$', '\\1' || doc_id) AS name, regexp_replace(owner, '^([TPE])N$', '\\1' || doc_id) AS owner,
  regexp_replace(regexp_replace(detail, '=EN', '=E' || doc_id, 'g'), '^TN=', 'T' || doc_id || '=') AS detail
FROM documents JOIN (VALUES {FOUND_SQL}) t(lang_no, kind, name, owner, detail, ending) ON doc_id % {len(TEXTS)} = lang_no
""")
def extract_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports (origin, alias), types (kind, fields), functions (class, parameters) and calls (caller) of seven languages."""
    rows = parse.parsed(numbered_sources(spark, sf_dir)).where("kind <> 'file'")
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    by = lambda **of: F.coalesce(*(F.when(F.col("kind") == F.lit(k.rstrip("_")), c) for k, c in of.items()), F.lit(""))
    owner = by(import_=F.col("origin"), type=F.col("type_kind"), function=F.col("class_name"), call=F.col("caller"))
    return rows.select("file", "kind", "name", owner.alias("owner"), by(import_=F.col("alias"), type=fields, function=F.array_join("params", "|")).alias("detail"))


def project_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files for each document: an interface and a base class, a class that implements and extends them, and a function that uses the interface."""
    n = F.col("doc_id").cast("string")
    texts = [
        ("base", "export interface Go { go(a: number): number; }\nexport class Base { stop() { return 1; } }\n"),
        ("impl", "import { Go, Base } from './base';\nexport class Impl extends Base implements Go {\n  go(a: number): number { return this.own(a); }\n  own(a: number) { return a; }\n}\n"),
        ("use", "import { Go } from './base';\nexport class User {\n  constructor(private g: Go) { }\n  run() { this.g.go(1); helper(); }\n}\nfunction helper() { return 2; }\n"),
    ]
    files = F.explode(F.array(*(F.struct(F.concat(F.lit("p"), n, F.lit(f"/{name}.ts")).alias("path"), F.lit(text).alias("text")) for name, text in texts)))
    return scan.with_language(read(spark, sf_dir, "documents").select(files.alias("f")).select("f.*"))


@query("""
SELECT 'p' || doc_id AS project, src, dst, type FROM documents, (VALUES ('use.ts', 'Go', 'IMPORTS'), ('impl.ts', 'Go', 'IMPORTS'), ('impl.ts', 'Base', 'IMPORTS'),
('Impl', 'Go', 'IMPLEMENTS'), ('Go', 'Impl', 'IMPLEMENTED_BY'), ('Impl', 'Base', 'EXTENDS'), ('Base', 'Impl', 'EXTENDED_BY'), ('Go', 'go', 'HAS_METHOD'), ('Base', 'stop', 'HAS_METHOD'), ('Impl', 'go', 'HAS_METHOD'),
('Impl', 'own', 'HAS_METHOD'), ('User', 'constructor', 'HAS_METHOD'), ('User', 'run', 'HAS_METHOD'), ('go', 'own', 'CALLS'), ('run', 'go', 'CALLS'), ('run', 'helper', 'CALLS'), ('run', 'go', 'CALLS_IMPLEMENTATION')) t(src, dst, type)
""")
def enrich_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of edges, across files: imports are resolved to files, and names to the files they are imported from."""
    sources = project_sources(spark, sf_dir)
    rows = written(parse.parsed(sources))
    found = resolve.resolve(rows.where("kind = 'import'").select("file", "lang", "origin", "ordinal"), sources, spark.createDataFrame([], "path string, dependency string"))
    imports = written(rows.where("kind = 'import'").select("file", "name", "ordinal").join(found.select("file", "ordinal", "resolved"), ["file", "ordinal"]))
    types, calls = map(written, graph.with_origins(
        rows.where("kind = 'type'").select("id", "name", "file", F.col("type_kind").alias("type"), "extends", "implements", "ordinal"),
        rows.where("kind = 'call'").select("owner_id", "name", "file", "caller", "ordinal"),
        imports,
    ))
    nodes, edges = graph.enrich(
        rows.where("kind = 'function'").select("id", "name", "file", "class_name", "ordinal"),
        types.select("id", "name", "file", F.col("type").alias("kind"), "extends", "implements", "ordinal"),
        calls.select(F.col("owner_id").alias("function_id"), F.col("name").alias("callee"), "target_file", "caller", "ordinal"),
        imports.select("file", F.col("name").alias("symbol"), "resolved", "ordinal"),
    )
    a, b = nodes.select(F.col("id").alias("src"), F.split("path", "/")[0].alias("project"), F.col("name").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("project", F.col("a").alias("src"), F.col("b").alias("dst"), "type")

"""Extraction of functions, types, imports and calls from source text, as one table function per file.

Python files are parsed with the standard library, the others by ``declarations``. Go has no rules. Every file has a row of kind ``file``, whose
``parse_ok`` is false if it is empty, of no known language or cannot be parsed; it has no other rows then.
"""

from __future__ import annotations

import ast
import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.storage import bounded_batches
from spandrel.sources import declarations
from spandrel.sources.scan import LANGUAGES

SCHEMA = "kind string, file string, lang string, id string, name string, scope array<string>, class_name string, params array<string>, returns string, start_line int, end_line int, extends array<string>, implements array<string>, owner_id string, caller string, origin string, alias string, ordinal int, type_kind string, fields map<string,string>, parse_ok boolean"
#: Files whose rows are held at once.
FILES = 250
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CONSTRUCTORS = {lang: constructor for lang, _, constructor, _, _ in LANGUAGES if lang != "go"}


def make_id(file: str, scope: list[str], name: str, start: int) -> str:
    return hashlib.sha256("::".join([file, *scope, name, str(start)]).encode()).hexdigest()


def _arguments(node: ast.AST) -> list[ast.arg]:
    return [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]


class _Python(ast.NodeVisitor):
    def __init__(self, file: str) -> None:
        self.file, self.rows, self.scope, self.classes, self.owner, self.owners, self.injected = file, [], [], [], None, [], {}

    def add(self, kind: str, name: str, **more) -> dict:
        row = dict.fromkeys(COLUMNS) | {"kind": kind, "file": self.file, "lang": "python", "name": name, "scope": list(self.scope), "ordinal": len(self.rows)} | more
        self.rows.append(row)
        return row

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", "*", origin=a.name, alias=a.asname)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", a.name, origin="." * node.level + (node.module or ""), alias=a.asname)

    def inside(self, node: ast.AST, name: str) -> None:
        self.scope.append(name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        fields = {}
        for child in node.body:
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                fields[child.name] = f"({', '.join(map(ast.unparse, _arguments(child)))}):{ast.unparse(child.returns) if child.returns else 'unknown'}"
                if child.name == CONSTRUCTORS["python"]:
                    self.injected[node.name] = {a.arg: ast.unparse(a.annotation) for a in _arguments(child) if a.annotation}
            elif isinstance(child, ast.AnnAssign):
                fields[ast.unparse(child.target)] = ast.unparse(child.annotation)
            elif isinstance(child, ast.Assign):
                fields |= {ast.unparse(t): "unknown" for t in child.targets}
        self.add("type", node.name, id=make_id(self.file, self.scope, node.name, node.lineno), type_kind="CLASS", extends=[ast.unparse(b) for b in node.bases], implements=[], fields=fields, start_line=node.lineno, end_line=node.end_lineno)
        self.classes.append(node.name)
        self.inside(node, node.name)
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.function(node, node.name, ast.unparse(node.returns) if node.returns else "")
        self.inside(node, node.name)
        self.owner = self.owners.pop()

    def function(self, node: ast.AST, name: str, returns: str) -> None:
        row = self.add("function", name, id=make_id(self.file, self.scope, name, node.lineno), class_name=self.classes[-1] if self.classes else "", params=[ast.unparse(a) for a in _arguments(node)], returns=returns, start_line=node.lineno, end_line=node.end_lineno)
        self.owners.append(self.owner)
        self.owner = row["id"]

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Lambda) and isinstance(node.targets[0], ast.Name):
            self.function(node.value, node.targets[0].id, "")
            self.generic_visit(node.value)
            self.owner = self.owners.pop()
        else:
            self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        chain = ast.unparse(node.func).split(".")
        if self.owner and re.fullmatch(r"\w+", chain[-1]):
            own = self.classes[-1] if self.classes else ""
            caller = "" if len(chain) == 1 else chain[0] if chain[0] != "self" else own if len(chain) == 2 else chain[1]
            self.add("call", chain[-1], owner_id=self.owner, caller=self.injected.get(own, {}).get(caller, caller))
        self.generic_visit(node)


def _others(file: str, lang: str, text: str, read: dict[tuple[str, str], list[dict]]) -> list[dict]:
    """Rows of a language that ``declarations`` reads, with their ids; ``read`` holds what was found in equal texts."""
    found = read.get((lang, text))
    if found is None:
        found = read[lang, text] = declarations.read(lang, text, CONSTRUCTORS[lang])
    rows: list[dict] = []
    for n, r in enumerate(found):
        row = dict.fromkeys(COLUMNS) | {"file": file, "lang": lang, "ordinal": n} | {k: v for k, v in r.items() if k != "owner"}
        if r["kind"] in ("type", "function"):
            row["id"] = make_id(file, r["scope"], r["name"], r["start_line"])
        elif r["kind"] == "call":
            row["owner_id"] = rows[r["owner"]]["id"]
        rows.append(row)
    return rows


def extract(file: str, lang: str | None, text: str | None, read: dict[tuple[str, str], list[dict]] | None = None) -> list[dict]:
    """Rows of one file, first that of the file itself with ``parse_ok``; one that cannot be parsed has no others. A text in ``read`` is not read again."""
    rows, ok = [], True
    if text and lang in CONSTRUCTORS:
        try:
            if lang == "python":
                visitor = _Python(file)
                visitor.visit(ast.parse(text))
                rows = visitor.rows
            else:
                rows = _others(file, lang, text, {} if read is None else read)
        except (SyntaxError, ValueError, RecursionError):
            ok = False
    else:
        ok = False
    return [dict.fromkeys(COLUMNS) | {"kind": "file", "file": file, "lang": lang, "parse_ok": ok, "ordinal": -1}, *rows]


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the files (path, lang, text) of each batch, those of at most FILES files at once: a file has many rows, which are large as Python objects.
    Of equal texts among these one is read."""
    for pdf in batches:
        for at in range(0, len(pdf), FILES):
            part = pdf.iloc[at : at + FILES]
            read: dict = {}
            rows = [r for path, lang, text in zip(part["path"], part["lang"], part["text"], strict=True) for r in extract(path, lang, text, read)]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("start_line", "end_line", "ordinal"):
                out[c] = out[c].astype("Int32")
            yield out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``frames`` from and to Arrow, column by column instead of value by value."""
    strings, numbers = pa.list_(pa.string()), ("start_line", "end_line", "ordinal")
    types = {"scope": strings, "params": strings, "extends": strings, "implements": strings, "fields": pa.map_(pa.string(), pa.string()), "parse_ok": pa.bool_()} | dict.fromkeys(numbers, pa.int32())
    for frame in frames(b.to_pandas() for b in batches):
        frame["fields"] = [None if f is None else list(f.items()) for f in frame["fields"]]
        yield pa.RecordBatch.from_arrays([pa.array(frame[c], types.get(c, pa.string()), from_pandas=True) for c in COLUMNS], names=COLUMNS)


def parsed(files: DataFrame) -> DataFrame:
    """All rows of all files (path, lang, text); a map without shuffle. Filter by kind and write once to use it several times."""
    bounded_batches(files.sparkSession)
    return files.select("path", "lang", "text").mapInArrow(batches_of, SCHEMA)


def check(lang: str | None, text: str | None) -> tuple[bool, str, str | None]:
    """Whether ``text`` is well formed, a status and the first error: Python and JSON by their parsers, others by their brackets."""
    if text is None:
        return False, "INVALID_INPUT", "no text"
    try:
        if lang == "python":
            ast.parse(text)
        elif lang == "json":
            json.loads(text)
        else:
            open_: list[str] = []
            for c in re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|(?s:/\*.*?\*/)", "", text):
                if c in "([{":
                    open_.append(c)
                elif c in ")]}" and (not open_ or open_.pop() != "([{"[")]}".index(c)]):
                    return False, "SYNTAX_ERROR", f"unexpected {c}"
            if open_:
                return False, "SYNTAX_ERROR", f"unclosed {open_[-1]}"
    except (SyntaxError, ValueError, RecursionError) as e:
        return False, "SYNTAX_ERROR", str(e)[:200]
    return True, "VALID", None


def _verdicts(lang: pd.Series, encoded: pd.Series) -> pd.DataFrame:
    out = []
    for code, data in zip(lang, encoded, strict=True):
        try:
            text = None if data is None else base64.b64decode(data).decode()
        except ValueError:
            text = None
        out.append(check(code, text))
    return pd.DataFrame(out, columns=["is_valid", "status", "error"])


def validate(lang: Column, encoded: Column) -> Column:
    """Struct (is_valid, status, error) for base64 texts, by Arrow batches."""
    return F.pandas_udf(_verdicts, "is_valid boolean, status string, error string")(lang, encoded)

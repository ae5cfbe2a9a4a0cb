"""Merges, folds and parsers on odd values."""

import json

from pyspark.sql import functions as F

from spandrel.functions import nested


def merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) if k not in b else b[k] for k in {**a, **b}}
    return b


def test_deep_merge(spark):
    cases = [
        ({"a": 1}, {"a": 2}), ({"a": {"b": {"c": 1, "d": [1, {"e": 2}]}}}, {"a": {"b": {"d": [3], "f": "x"}}}), ({"a": {"b": 1}}, {"a": None}), ({"a": None}, {"a": {"b": 1}}), ({"a": [1]}, {"a": {"b": 1}}), ({"a": {"b": 1}}, {"a": [2]}),
        ({}, {}), ({"x": {}}, {"x": {"y": {}}}), ({"é k": {"q": True}}, {"é k": {"r": 1.5}}), ([1], {"a": 1}), ({"a": 1}, "text"),
        ({"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": 1, "9": 2}}}}}}}}, {"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": 3}}}}}}}}),
    ]
    d = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: json.loads(r.m) for r in d.select("k", F.to_json(nested.deep_merge(nested.try_json(F.col("a")), nested.try_json(F.col("b")))).alias("m")).collect()}
    assert got == {k: merge(a, b) for k, (a, b) in enumerate(cases)}
    one = spark.createDataFrame([('{"a":1}', None), (None, '{"a":1}'), (None, None)], "a string, b string")
    assert [r.m for r in one.select(F.to_json(nested.deep_merge(nested.try_json(F.col("a")), nested.try_json(F.col("b")))).alias("m")).collect()] == ['{"a":1}', '{"a":1}', None]


def fold(items):
    out = []
    for x in items:
        if out and not any(v is not None and w is not None for v, w in zip(x, out[-1], strict=True)):
            out[-1] = tuple(v if v is not None else w for v, w in zip(x, out[-1], strict=True))
        else:
            out.append(tuple(x))
    return out


def test_append_or_update(spark):
    n = None
    cases = [[("a", n, n), ("b", n, n), (n, "t", n), ("c", n, n), (n, "u", n), (n, n, "v")], [(n, n, n), (n, n, n)], [("a", "b", n), (n, "c", n), (n, n, "d"), ("e", n, n)], []]
    d = spark.createDataFrame([(k, c) for k, c in enumerate(cases)] + [(9, None)], "k int, i array<struct<name:string,type:string,def:string>>")
    got = {r.k: r.f for r in d.select("k", nested.appended_or_updated(F.col("i"), ["name", "type", "def"]).alias("f")).collect()}
    assert got.pop(9) is None
    assert {k: [tuple(x) for x in v] for k, v in got.items()} == {k: fold(c) for k, c in enumerate(cases)}


def test_parsers_give_null_for_broken_text(spark):
    d = spark.createDataFrame([('{"a": [1, {"b": "é"}]}', "<r><a>1</a></r>", "a = 1\nb = 2024-01-01"), ("{", "<r><a>", "a = "), (None, None, None), ("", "", "")], "j string, x string, t string")
    got = d.select(F.to_json(nested.try_json(F.col("j"))).alias("j"), nested.try_xml(F.col("x"), "a int")["a"].alias("x"), F.to_json(nested.try_toml(F.col("t"))).alias("t")).collect()
    assert [tuple(r) for r in got] == [('{"a":[1,{"b":"é"}]}', 1, '{"a":1,"b":"2024-01-01"}'), (None, None, None), (None, None, None), (None, None, "{}")]

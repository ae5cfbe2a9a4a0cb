"""Nested records: parse or null, deep merge of variants, and a fold that appends to a list or fills in its last element."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels of objects that a merge goes down; deeper ones are replaced.
DEPTH = 8
OBJECT = "map<string,variant>"


def try_json(text: Column) -> Column:
    """A variant, null for what is no JSON."""
    return F.try_parse_json(text)


def try_xml(text: Column, schema: str) -> Column:
    """A struct of ``schema``, null for what is no XML."""
    found = F.from_xml(text, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.when(found["_broken"].isNull(), found)


def _toml(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(tomllib.loads(text), default=str)
        except tomllib.TOMLDecodeError:
            return None

    for batch in texts:
        yield batch.map(one)


def try_toml(text: Column) -> Column:
    """A variant, null for what is no TOML; dates become text. The parser is Python's."""
    return F.try_parse_json(F.pandas_udf(_toml, StringType())(text))


def deep_merge(old: Column, new: Column, depth: int = DEPTH) -> Column:
    """Variant ``old`` with the values of ``new``: objects are merged key by key, all other values (arrays and nulls too) replaced. A null of SQL changes nothing."""

    def both(a: Column, b: Column, left: int) -> Column:
        x, y = (F.try_variant_get(v, "$", OBJECT) for v in (a, b))
        newer = F.map_zip_with(x, y, lambda k, p, q: F.when(~F.map_contains_key(y, k), p).otherwise(both(p, q, left - 1) if left > 1 else q))
        return F.when(x.isNotNull() & y.isNotNull(), F.to_variant_object(newer)).otherwise(F.coalesce(b, a))

    return both(old, new, depth)


def appended_or_updated(items: Column, fields: list[str]) -> Column:
    """The array of structs that ``items`` (an array of structs with ``fields``, in order) folds into: an item whose fields the last element lacks fills it in, any other begins a new element.

    Null fields of an item are not given. Null items are passed over; an empty array stays empty, a null one null.
    """

    def step(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        clash = F.lit(False)
        for f in fields:
            clash = clash | (item[f].isNotNull() & last[f].isNotNull())
        pairs = [x for f in fields for x in (F.lit(f), F.coalesce(item[f], last[f]))]
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) == 0) | clash, F.concat(done, F.array(item))).otherwise(F.concat(kept, F.array(F.named_struct(*pairs))))

    given = F.filter(items, lambda x: x.isNotNull())
    return F.aggregate(given, F.slice(given, 1, 0), step)

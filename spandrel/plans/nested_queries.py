"""Nested records of events, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import nested
from spandrel.plans.registry import query
from spandrel.sources.tables import read


@query("""
WITH t AS (SELECT event_id, '{"a":{"b":{"x":' || json_extract_string(props, '$.k') || '},"c":[1,2]},"k":' || json_extract_string(props, '$.k') || '}' AS old,
  CASE event_id % 4 WHEN 0 THEN '{"a":{"b":{"y":' || user_id || '},"c":[' || event_id || ']},"z":"' || event_type || '"}' WHEN 1 THEN '{"a":{"b":7}}' WHEN 2 THEN '{"k":{"v":true}}' ELSE '{}' END AS new FROM events)
SELECT event_id, TRY_CAST(m->>'$.a.b.x' AS BIGINT) AS x, TRY_CAST(m->>'$.a.b.y' AS BIGINT) AS y, TRY_CAST(m->>'$.a.b' AS BIGINT) AS b, CAST(m->'$.a.c' AS VARCHAR) AS c, TRY_CAST(m->>'$.k' AS BIGINT) AS k, TRY_CAST(m->>'$.k.v' AS BOOLEAN) AS v, m->>'$.z' AS z
FROM (SELECT event_id, json_merge_patch(old, new) AS m FROM t)
""")
def nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties, wrapped two objects deep, with updates that meet objects, arrays and plain values."""
    k, text = F.get_json_object("props", "$.k"), lambda c: F.col(c).cast("string")
    old = F.concat(F.lit('{"a":{"b":{"x":'), k, F.lit('},"c":[1,2]},"k":'), k, F.lit("}"))
    first = F.concat(F.lit('{"a":{"b":{"y":'), text("user_id"), F.lit('},"c":['), text("event_id"), F.lit(']},"z":"'), F.col("event_type"), F.lit('"}'))
    new = F.when(F.col("event_id") % 4 == 0, first).when(F.col("event_id") % 4 == 1, '{"a":{"b":7}}').when(F.col("event_id") % 4 == 2, '{"k":{"v":true}}').otherwise("{}")
    merged = read(spark, sf_dir, "events").select("event_id", nested.deep_merge(nested.try_json(old), nested.try_json(new)).alias("m"))
    at = lambda path, kind: F.try_variant_get("m", path, kind)
    return merged.select("event_id", at("$.a.b.x", "bigint").alias("x"), at("$.a.b.y", "bigint").alias("y"), at("$.a.b", "bigint").alias("b"), F.to_json(at("$.a.c", "variant")).alias("c"), at("$.k", "bigint").alias("k"), at("$.k.v", "boolean").alias("v"), at("$.z", "string").alias("z"))


@query("""
SELECT page_id, kind, CASE WHEN page_id % 3 <> 0 THEN page_id END AS value FROM pages, (VALUES ('json'), ('xml'), ('toml')) t(kind)
""")
def try_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each page in three formats, every third one cut off."""
    n, broken = F.col("page_id").cast("string"), F.col("page_id") % 3 == 0
    texts = {"json": ('{"u": {"n": ', '}, "s": "x"}'), "xml": ("<r><n>", "</n></r>"), "toml": ("[u]\nn = ", "\ns = 'x'\n")}
    cut = {kind: F.when(broken, F.concat(F.lit(a), n, F.lit(' "'))).otherwise(F.concat(F.lit(a), n, F.lit(b))) for kind, (a, b) in texts.items()}
    inner = lambda v: F.variant_get(v, "$.u.n", "bigint")
    found = {"json": inner(nested.try_json(cut["json"])), "xml": nested.try_xml(cut["xml"], "n bigint")["n"], "toml": inner(nested.try_toml(cut["toml"]))}
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in found.items())))
    return read(spark, sf_dir, "pages").select("page_id", rows.alias("r")).select("page_id", "r.*")


@query("""
WITH t AS (SELECT conv_id, list({'s': CASE WHEN role = 'system' THEN turn END, 'q': CASE WHEN role = 'user' THEN turn END, 'a': CASE WHEN role = 'assistant' THEN turn END} ORDER BY turn) AS l FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN (acc[-1].s IS NOT NULL AND y[1].s IS NOT NULL) OR (acc[-1].q IS NOT NULL AND y[1].q IS NOT NULL) OR (acc[-1].a IS NOT NULL AND y[1].a IS NOT NULL) THEN list_concat(acc, y)
  ELSE list_concat(acc[:-2], [{'s': coalesce(y[1].s, acc[-1].s), 'q': coalesce(y[1].q, acc[-1].q), 'a': coalesce(y[1].a, acc[-1].a)}]) END) AS f FROM t)
SELECT conv_id, array_to_string(list_transform(f, lambda x: coalesce(x.s::VARCHAR, '-') || '/' || coalesce(x.q::VARCHAR, '-') || '/' || coalesce(x.a::VARCHAR, '-')), ' ') AS exchanges FROM f
""")
def append_or_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation folded into exchanges: at most one turn of each role, in the order of the turns."""
    c = read(spark, sf_dir, "conversations").where(F.col("role").isin("system", "user", "assistant"))
    item = F.struct(*(F.when(F.col("role") == role, F.col("turn")).alias(name) for name, role in (("s", "system"), ("q", "user"), ("a", "assistant"))))
    turns = c.select("conv_id", "turn", item.alias("item")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("t"))
    folded = nested.appended_or_updated(F.transform("t", lambda x: x["item"]), ["s", "q", "a"])
    shown = F.transform(folded, lambda x: F.concat_ws("/", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in ("s", "q", "a"))))
    return turns.select("conv_id", F.array_join(shown, " ").alias("exchanges"))

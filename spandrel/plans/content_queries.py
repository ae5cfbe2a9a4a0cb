"""Related nodes of all nodes, and content cut out of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import content, related
from spandrel.plans.registry import query
from spandrel.sources.tables import TRADE_SQL, key, read, trade_edges

# The trade graph as code: customers and suppliers are functions and nations classes; a nation is a file.
CODE_SQL = f"""{TRADE_SQL}, place AS (SELECT 'c:' || c_custkey AS id, 'FUNCTION' AS type, c_nationkey AS path FROM customer UNION ALL SELECT 's:' || s_suppkey, 'FUNCTION', s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'CLASS', n_nationkey FROM nation),
x AS MATERIALIZED (SELECT edges.*, a.type AS st, a.path AS sp, b.type AS dt, b.path AS dp FROM edges JOIN place a ON src = a.id JOIN place b ON dst = b.id)"""


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "c", "c_custkey", "c_nationkey", "FUNCTION"), ("supplier", "s", "s_suppkey", "s_nationkey", "FUNCTION"), ("nation", "n", "n_nationkey", "n_nationkey", "CLASS")]
    frames = [read(spark, sf_dir, t).select(key(p, c).alias("id"), F.lit(kind).alias("type"), F.col(at).cast("string").alias("path")) for t, p, c, at, kind in parts]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


RULES_SQL = "(" + " OR ".join(f"(k = '{k}' AND type = '{t}')" for k, t in related.RULES) + ")"


@query(f"""WITH {CODE_SQL},
h AS (SELECT dst AS start, dt AS k, dp AS p, type, src AS other, st AS ot, sp AS op FROM x UNION ALL SELECT src, st, sp, type, dst, dt, dp FROM x WHERE src <> dst),
r AS (SELECT * FROM h WHERE {RULES_SQL})
SELECT start, other, type AS edge_type, 1 AS hop FROM r
UNION ALL SELECT DISTINCT start, src, 'HAS_METHOD', 2 FROM r JOIN x ON other = x.dst AND x.type = 'HAS_METHOD' AND x.st = 'CLASS' WHERE ot = 'FUNCTION' AND op <> p""")
def related_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related nodes of every node in both directions, and the classes of functions in other files."""
    return related.related(code_nodes(spark, sf_dir), trade_edges(spark, sf_dir), "BOTH")


MARKS = ["//", "/*", "*/", "*", "a", "L"]
SPACE_SQL = "' ' || " + " || ".join(f"chr({ord(c)})" for c in content.SPACE[1:])


@query(f"""
WITH d AS (SELECT doc_id, text, length(text) AS n, {SPACE_SQL} AS ws FROM documents WHERE text <> ''),
r AS (SELECT doc_id, k * n // 4 AS s, least(n, k * n // 4 + n // 6 + doc_id % 7 * 20) AS e FROM d, range(3) t(k)),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)) GROUP BY doc_id, g),
l AS (SELECT doc_id, s, e, ws, string_split(substr(text, s + 1, e - s), chr(10)) AS l, len(string_split(substr(text, 1, s), chr(10))) - 1 AS row_, len(string_split(substr(text, 1, e), chr(10))) - 1 AS end_row, string_split(text, chr(10)) AS every FROM m JOIN d USING (doc_id)),
c AS (SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda i: trim(l[i], ws) <> '' AND NOT regexp_matches(trim(l[i], ws), '^(//|/\\*|\\*/|\\*|a|L)'))) AS last, list_min(list_filter(range(1, len(l) + 1), lambda i: trim(l[i], ws) <> '')) AS first FROM l),
p AS (SELECT *, array_to_string(list_transform(range(first, last + 1), lambda i: trim((row_ + i)::VARCHAR || ': ' || l[i], ws)), chr(10)) AS piece FROM c),
o AS (SELECT doc_id, coalesce(string_agg(piece, chr(10) || chr(10) || '<- CUT CONTENT ->' || chr(10) || chr(10) ORDER BY s) FILTER (last IS NOT NULL), '') AS body, arg_min(row_, s) AS from_row, arg_max(end_row, s) AS until, any_value(every) AS every, any_value(ws) AS ws FROM p GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN from_row > 0 THEN chr(10) || '<- CUT CONTENT ->' || chr(10) || chr(10) ELSE '' END || body || CASE WHEN until < len(every) - 1 AND trim(array_to_string(every[until + 2:], chr(10)), ws) <> '' THEN chr(10) || chr(10) || '<- CUT CONTENT ->' || chr(10) ELSE '' END) AS content FROM o
""")
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranges of each text, which may overlap, merged and cut out; lines that begin with some marks count as comments."""
    d = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", F.length("text").alias("n"))
    k = F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k")
    start = F.floor(F.col("k") * F.col("n") / 4)
    ranges = d.select("doc_id", "n", k).select("doc_id", start.alias("start"), F.least(F.col("n"), start + F.floor(F.col("n") / 6) + F.col("doc_id") % 7 * 20).alias("end"))
    found = content.assembled(ranges, d.select("doc_id", "text", F.array(*map(F.lit, MARKS)).alias("comments")), "doc_id")
    return found.select("doc_id", F.md5("content").alias("content"))

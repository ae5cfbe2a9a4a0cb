"""Filters, functions and views that the larger queries do not show on their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import scalar
from spandrel.operators import content, graph, intervals, relevance, similarity, tasks, traverse
from spandrel.operators.storage import shared_folder
from spandrel.plans.graph_queries import report, report_sql, starts
from spandrel.plans.registry import SQL, query
from spandrel.plans.text_queries import LINES_SQL, marked_lines
from spandrel.sources import scan
from spandrel.sources.tables import TRADE_SQL, read, trade_edges, trade_nodes

# Paths and files


@query("SELECT page_id, url FROM pages WHERE contains(url, 'blog') OR contains(url, '/de/')")
def path_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url").where(scan.matches_keywords(F.col("url"), ["blog", "/de/"]))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN len(string_split(substr(url, instr(url, '://') + 3), '/')) >= 3 AND contains(url, '.org') WHEN 2 THEN true ELSE false END AS is_repository FROM pages")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses at a known host, with a known host put in the place of some, as organisation/name, and others."""
    n, host = F.col("page_id"), F.regexp_replace("url", r"^[a-z]+://[^/]*\.org", "https://gitlab.com")
    url = F.when(n % 5 == 0, F.concat(F.lit("https://github.com/o/r"), n.cast("string"))).when(n % 5 == 1, host).when(n % 5 == 2, F.concat(F.lit("org/r"), n.cast("string"))).when(n % 5 == 3, F.col("url")).otherwise("plain")
    return read(spark, sf_dir, "pages").select("page_id", scalar.is_git_url(url).alias("is_repository"))


@query("SELECT doc_id, 'm' || doc_id AS name FROM documents WHERE doc_id % 10 = 3")
def file_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one file; its path is written in two ways."""
    n = F.col("doc_id").cast("string")
    f = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), F.lit(".ts:C:m"), n).alias("key"), F.concat(F.lit(" src\\f"), (F.col("doc_id") % 10).cast("string"), F.lit(".ts")).alias("file"))
    return content.functions_of(f, F.lit("src/f3.ts")).select("doc_id", "name")


@query("SELECT page_id AS id, url AS path FROM pages WHERE contains(url, '/en/1')")
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.nodes_of(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path")), F.lit("/en/1"))


# The graph


@query(report_sql(["s:1", "s:2"], "backward", 1))
def impact_backward_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir, ["s:1", "s:2"], "backward", 1)


@query(f"WITH {TRADE_SQL} SELECT DISTINCT 's:1' AS start, src AS id, 1 AS level FROM edges WHERE type = 'CALLS' AND dst = 's:1'")
def impact_calls_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of edges, one type of nodes."""
    found = traverse.impact(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir), starts(spark, ["s:1"]), types=["CALLS"], depth=1, only="CUSTOMER", lists=False)
    return found.select("start", "id", "level")


@query("SELECT 'n:' || c_nationkey AS id, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_imported_by FROM customer GROUP BY 1")
def imported_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importers of each node; customers import their nation here."""
    e = trade_edges(spark, sf_dir).where("type = 'EXTENDS'").withColumn("type", F.lit("IMPORTS"))
    return traverse.incoming(e, "IMPORTS").groupBy("id").agg(F.count("*").alias("n_imported_by"))


@query("SELECT 'HAS_METHOD' AS type UNION ALL SELECT 'CALLS' UNION ALL SELECT 'EXTENDS'")
def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.types(trade_edges(spark, sf_dir))


@query(f"WITH {TRADE_SQL} SELECT 'edge' AS kind, type, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY type UNION ALL SELECT 'node', type, count(*) FROM nodes GROUP BY type")
def graph_saved_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    scan.write_graph(trade_nodes(spark, sf_dir), trade_edges(spark, sf_dir), folder)
    nodes, edges = scan.read_graph(spark, folder)
    of = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return of(edges, "edge").unionAll(of(nodes, "node"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand END AS owner, CASE WHEN p_size > 25 THEN 'new' ELSE p_type END AS path FROM part")
def owner_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts get their brand as owner; of two rows the later one holds."""
    p = read(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("owner"), F.col("p_type").alias("path"))
    late = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), F.lit("new").alias("path"), F.lit(2).alias("ordinal"))
    return graph.with_owners(nodes, late.unionAll(late.select("id", F.lit("old"), F.lit("old"), F.lit(1)))).select("id", "owner", "path")


@query("SELECT p_brand || '/' || p_type AS key, array_to_string(list_sort(list_distinct(list('s' || p_size % 5))), ',') AS extends, arg_max('v' || p_partkey, p_partkey) AS field FROM part GROUP BY 1")
def type_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a type in several files: all parents, the last field."""
    p, text = read(spark, sf_dir, "part"), lambda c: c.cast("string")
    types = p.select(F.concat("p_brand", F.lit("/"), "p_type").alias("key"), F.array(F.concat(F.lit("s"), text(F.col("p_size") % 5))).alias("extends"), F.array().cast("array<string>").alias("implements"), F.create_map(F.lit("f"), F.concat(F.lit("v"), text(F.col("p_partkey")))).alias("fields"), F.col("p_partkey").alias("ordinal"))
    return graph.merge_types(types).select("key", F.array_join(F.array_sort("extends"), ",").alias("extends"), F.col("fields")["f"].alias("field"))


@query("SELECT o_custkey AS file, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS names FROM orders GROUP BY o_custkey")
def unique_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderpriority")
    return graph.defined_once(o, "file", "o_orderpriority").select("file", F.array_join("names", "|").alias("names"))


@query("""
WITH d AS (SELECT doc_id, lang, source, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT lang, source, t, min(doc_id) AS rep FROM d GROUP BY lang, source, t),
p AS (SELECT a.rep AS one, b.rep AS other, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM c a JOIN c b ON a.lang = b.lang AND a.source = b.source AND a.rep < b.rep)
SELECT 'member' AS kind, rep AS one, doc_id AS other, 1.0 AS similarity FROM d JOIN c USING (lang, source, t)
UNION ALL SELECT 'link', one, other, round(i / (n - i), 6) FROM p WHERE i >= 0.5 * (n - i) AND n > 0
""")
def clone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions: the signature is made of source and language; copies are members, classes are linked."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), scalar.signature_hash(F.array(F.concat(F.lit("p: "), "source")), "lang").alias("signature"), "text")
    members, links = similarity.clone_classes(d, ["signature"])
    return members.select(F.lit("member").alias("kind"), F.col("clone_class").alias("one"), F.col("id").alias("other"), F.lit(1.0).alias("similarity")).unionByName(links.select(F.lit("link").alias("kind"), "one", "other", F.round("similarity", 6).alias("similarity")))


# Lines and text


@query(f"SELECT hunk, CAST(sum(end_row - start_row + 1) AS BIGINT) AS added FROM ({SQL['line_blocks']}) GROUP BY hunk")
def added_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = intervals.added_blocks(marked_lines(spark, sf_dir))
    return blocks.groupBy("hunk").agg(F.sum(relevance.line_total(F.col("start_row"), F.col("end_row"))).alias("added"))


@query(f"SELECT doc_id, CAST(coalesce(max(line_no) FILTER (trim(line) <> '' AND NOT regexp_matches(trim(line), '^(#|L|a)')), -1) AS INT) AS last_code_line FROM {LINES_SQL} GROUP BY doc_id")
def last_code_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line that is neither blank nor a comment; lines that begin with some marks are comments."""
    prefixes = F.array(*map(F.lit, ("#", "L", "a")))
    at = content.last_match(scalar.lines("text"), lambda x: ~relevance.is_comment_or_blank(x, prefixes))
    return read(spark, sf_dir, "documents").select("doc_id", at.alias("last_code_line"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderpriority || '::' || o_orderstatus END AS scope FROM orders")
def scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.struct(F.col(c).alias("name"), F.lit("x").alias("type"))
    scope = F.when(F.col("o_orderkey") % 3 == 0, F.array(part("o_orderpriority"))).otherwise(F.array(part("o_orderpriority"), part("o_orderstatus")))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.scope_path(scope).alias("scope"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: '+' || x), chr(10))) AS plain FROM documents")
def diff_without_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines with their numbers, and the numbers taken off again."""
    marked = F.array_join(F.transform(scalar.lines("text"), lambda x: F.concat(F.lit("+"), x)), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(scalar.strip_numbering(scalar.number_lines(marked, F.lit(7)))).alias("plain"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed FROM documents")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(scalar.squeeze("text")).alias("squeezed"))


@query("SELECT doc_id, md5(base64(encode(text))) AS encoded FROM documents")
def text_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(scalar.encoded("text")).alias("encoded"))


# Tasks


@query("SELECT event_id, greatest(0, least(100, value * 2 - 50)) AS progress, CASE WHEN event_id % 6 IN (1, 2, 3) THEN event_id % 6 ELSE 2 END AS priority FROM events")
def task_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalar.clamp_progress(F.col("value") * 2 - 50).alias("progress"), scalar.priority(F.col("event_id") % 6).alias("priority"))


@query("SELECT o_orderkey, CAST(least(300000, floor(30000 * greatest(1.0, ceil(o_totalprice * 1000 / 1048576) / 10))) AS BIGINT) AS timeout_ms FROM orders")
def upload_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.upload_timeout_ms(F.col("o_totalprice") * 1000).alias("timeout_ms"))


@query("SELECT event_id, '{\"token\":\"[REDACTED]\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS body FROM events")
def redacted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.create_map(F.lit("token"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return read(spark, sf_dir, "events").select("event_id", F.to_json(scalar.redact(body)).alias("body"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'ast.one' WHEN 'view' THEN 'ast.two' ELSE 'ast.custom.' || event_type END AS route FROM events")
def routing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalar.routing_key(F.when(F.col("event_type") == "error", "ERROR").otherwise(F.col("event_type")), {"click": "ast.one", "view": "ast.two"}).alias("route"))


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 77, 4242, 99999999)")
def task_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.by_id(read(spark, sf_dir, "orders"), "o_orderkey", [1, 77, 4242, 99_999_999])


@query("SELECT task_id, event_id FROM (SELECT user_id AS task_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS odd, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type = 'click' AND odd = 1")
def task_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose last state holds all of a partial record."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", F.struct(F.col("event_type").alias("status"), F.struct((F.from_json("props", "k long")["k"] % 2).alias("odd")).alias("metadata")).alias("record"))
    return tasks.latest(e, "task_id", "event_id").where(scalar.partial_match(F.col("record"), {"status": "click", "metadata": {"odd": 1}})).select("task_id", "event_id")


@query("""
SELECT c_custkey AS task_id, CASE c_custkey % 6 WHEN 0 THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN c_custkey % 6 = 0 THEN least(100, c_custkey) ELSE 5 END AS progress,
  CASE WHEN c_custkey % 6 = 0 THEN '{"a":"1","b":"' || c_custkey || '"}' ELSE '{"b":"0","a":"1"}' END AS metadata, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS retry_count, CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END AS version FROM customer
""")
def task_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third task is to change, but every other of these changes expects another version."""
    c, text = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")), F.col("task_id").cast("string")
    old = c.select("task_id", F.lit("PENDING").alias("status"), F.lit(5).cast("long").alias("progress"), F.create_map(F.lit("b"), F.lit("0"), F.lit("a"), F.lit("1")).alias("metadata"), F.lit(0).alias("retry_count"), F.lit(1).alias("version"))
    new = c.where("task_id % 3 = 0").select("task_id", F.lit("FAILED").alias("status"), F.col("task_id").alias("progress"), F.create_map(F.lit("b"), text).alias("metadata"), F.lit(True).alias("retry"), (F.col("task_id") % 2 * 8 + 1).cast("int").alias("expected_version"))
    return tasks.update(old, new).withColumn("metadata", F.to_json("metadata"))

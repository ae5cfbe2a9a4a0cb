"""Change impact, reachability and graph building over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.operators import graph, traverse
from spandrel.operators.storage import written
from spandrel.plans.registry import query
from spandrel.sources.tables import TRADE_SQL, read, trade_edges, trade_nodes

SEVERITY_SQL = """
sev AS (SELECT id, max(CASE WHEN type IN ('CALLS', 'CALLS_IMPLEMENTATION') THEN 2 WHEN type IN ('IMPLEMENTS', 'EXTENDS', 'IMPLEMENTED_BY') THEN 1 ELSE 0 END) AS r
  FROM (SELECT src AS id, type FROM edges UNION ALL SELECT dst, type FROM edges) GROUP BY id),
callers AS (SELECT dst AS id, count(DISTINCT src) AS n FROM edges WHERE type = 'CALLS' GROUP BY dst)
"""


def starts(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "start string")


def report(spark: SparkSession, sf_dir: str, ids: list[str], direction: str, depth: int) -> DataFrame:
    edges = trade_edges(spark, sf_dir)
    found = traverse.impact(trade_nodes(spark, sf_dir), edges, starts(spark, ids), direction, depth=depth, lists=False)
    return found.select("start", "id", "type", "level", "severity", F.col("n_called_by").alias("n_callers"))


def report_sql(ids: list[str], direction: str, depth: int) -> str:
    moves = {"backward": "SELECT DISTINCT dst AS here, src AS there FROM edges", "forward": "SELECT DISTINCT src AS here, dst AS there FROM edges", "both": "SELECT DISTINCT src AS here, dst AS there FROM edges UNION SELECT dst, src FROM edges"}[direction]
    levels = ["l0 AS (" + " UNION ALL ".join(f"SELECT '{i}' AS start, '{i}' AS id, 0 AS level" for i in ids) + ")"]
    for k in range(1, depth + 1):
        levels.append(f"l{k} AS MATERIALIZED (SELECT start, id, min(level) AS level FROM (SELECT * FROM l{k - 1} UNION ALL SELECT start, there, {k} FROM l{k - 1} JOIN moves ON id = here WHERE level = {k - 1}) GROUP BY start, id)")
    return f"""WITH {TRADE_SQL}, {SEVERITY_SQL}, moves AS ({moves}), {", ".join(levels)}
SELECT start, l.id, nodes.type, CAST(level AS INT) AS level, CASE coalesce(r, 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CAST(coalesce(n, 0) AS BIGINT) AS n_callers
FROM l{depth} l JOIN nodes ON l.id = nodes.id LEFT JOIN sev ON l.id = sev.id LEFT JOIN callers ON l.id = callers.id"""


@query(report_sql(["s:1"], "backward", 2))
def impact_backward_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: who depends on a supplier, at what distance, how severely."""
    return report(spark, sf_dir, ["s:1"], "backward", 2)


@query(report_sql(["c:1", "c:2", "c:3"], "forward", 1))
def impact_forward_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir, ["c:1", "c:2", "c:3"], "forward", 1)


@query(report_sql(["s:1", "n:3"], "both", 1))
def impact_both_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir, ["s:1", "n:3"], "both", 1)


@query(
    "WITH r AS (" + report_sql(["s:1", "s:2", "n:3"], "backward", 2) + "), t AS (SELECT start, type, count(*) AS n, max(level) AS top FROM r GROUP BY start, type) "
    "SELECT start, CAST(sum(n) AS BIGINT) AS total_impact, CAST(max(top) AS INT) AS highest_level, string_agg(type || '=' || n, ',' ORDER BY type) AS impact_by_type FROM t GROUP BY start"
)
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.summary(report(spark, sf_dir, ["s:1", "s:2", "n:3"], "backward", 2))
    return found.withColumn("impact_by_type", F.array_join(F.transform(F.map_entries("impact_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's purchase leads to the user of the next one in time; cyclic.

    Purchases are ordered hour by hour, so that no task orders all of them; only the first and last user of each hour, one row an hour, meet in one window.
    """
    order = F.struct("ts", "event_id")
    bought = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", F.col("user_id").cast("string").alias("src"), F.date_trunc("hour", "ts").alias("hour"))
    inside = bought.select("src", F.lead("src").over(Window.partitionBy("hour").orderBy("ts", "event_id")).alias("dst"))
    ends = bought.groupBy("hour").agg(F.min_by("src", order).alias("first"), F.max_by("src", order).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("hour")).alias("dst"))
    return inside.unionAll(across).where("dst IS NOT NULL").distinct().withColumn("type", F.lit("NEXT"))


CLOSURE_SQL = """WITH RECURSIVE bought AS (SELECT ts, event_id, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT src, dst FROM (SELECT u AS src, lead(u) OVER (ORDER BY ts, event_id) AS dst FROM bought) WHERE dst IS NOT NULL),
r AS (SELECT DISTINCT src AS start, src AS id FROM e UNION SELECT start, dst FROM r JOIN e ON id = src)"""


@query(CLOSURE_SQL + " SELECT start, id FROM r")
def reachability_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a start and a user reachable from it, from every user with a next one; the result itself is as large as the closure.

    It is spelled out from the components: members of a start's component and of those it reaches.
    """
    edges = written(purchase_edges(spark, sf_dir))
    members, links = traverse.condensed(edges)
    own = members.select("component", F.col("component").alias("reached")).distinct().unionAll(links)
    starts = members.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return traverse.spelled_out(starts.withColumnRenamed("node", "start"), own, members)


@query(CLOSURE_SQL + """, p AS (SELECT start, id FROM r UNION SELECT dst, dst FROM e),
m AS (SELECT a.start AS node, min(a.id) AS component FROM p a JOIN p b ON a.start = b.id AND a.id = b.start GROUP BY a.start)
SELECT 'member' AS kind, component, node AS other FROM m
UNION ALL SELECT DISTINCT 'link', a.component, b.component FROM p JOIN m a ON p.start = a.node JOIN m b ON p.id = b.node WHERE a.component <> b.component""")
def reachability_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same closure without its pairs: members of each strongly connected component, and links to the components it reaches."""
    members, links = traverse.condensed(purchase_edges(spark, sf_dir))
    return members.select(F.lit("member").alias("kind"), "component", F.col("node").alias("other")).unionAll(links.select(F.lit("link"), "component", "reached"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def edge_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return graph.first_by(orders, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT user_id AS id, event_id AS ordinal, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def node_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dedup_nodes(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("name")))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT e.event_id AS ref_id, n.event_id AS node_id FROM events e JOIN n ON e.event_type = n.event_type AND e.user_id = n.user_id AND n.rn = 1
""")
def node_lookup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to (name, path) get the last node so named; every event is a reference."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("id"), F.col("event_id").alias("ordinal"))
    refs = events.select("name", "path", F.col("id").alias("ref_id"))
    return graph.lookup(refs, events).select("ref_id", "node_id")


@query(f"WITH {TRADE_SQL}, kept AS (SELECT id FROM nodes WHERE type <> 'NATION') SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def edge_endpoint_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.existing_ends(trade_edges(spark, sf_dir), trade_nodes(spark, sf_dir).where("type <> 'NATION'"))


@query("SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'EXTENDS' AS type FROM customer UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'EXTENDED_BY' FROM customer")
def inverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_inverse(trade_edges(spark, sf_dir).where("type = 'EXTENDS'"))


@query("""
WITH n AS (SELECT p_brand AS name, p_type AS path, p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS owner, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) AS rn FROM part),
r AS (SELECT p_partkey AS ref_id, p_brand AS name, p_type AS path, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'other' END AS caller FROM part)
SELECT r.ref_id, n.id AS node_id FROM r JOIN n ON r.name = n.name AND r.path = n.path AND n.rn = 1 AND n.owner = r.caller
""")
def owner_qualified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("path"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("owner"), F.col("p_partkey").alias("ordinal"))
    caller = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("other")
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("path"), caller.alias("caller"))
    return graph.lookup(refs, nodes, owner=True).select("ref_id", "node_id")


@query("""
WITH t AS (SELECT r_name AS name, [] AS ext FROM region UNION ALL SELECT n_name, [r_name] FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT p AS name, string_agg(name, ',' ORDER BY name) AS by_ FROM (SELECT name, unnest(ext) AS p FROM t) GROUP BY p)
SELECT t.name, coalesce(by_, '') AS extended_by FROM t LEFT JOIN b ON t.name = b.name
""")
def inverse_type_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    none = F.array().cast("array<string>")
    types = region.select(F.col("r_name").alias("name"), none.alias("extends"), none.alias("implements")).unionAll(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.array("r_name"), none))
    return graph.inverse_types(types).select("name", F.array_join("extended_by", ",").alias("extended_by"))


@query(f"""WITH {TRADE_SQL}, s AS (SELECT id FROM nodes WHERE id IN ('s:1', 's:2', 'n:5')),
m AS (SELECT s.id AS start, src AS other, type, 'TO' AS direction FROM s JOIN edges ON dst = s.id WHERE type IN ('CALLS', 'HAS_METHOD') UNION ALL SELECT s.id, dst, type, 'FROM' FROM s JOIN edges ON src = s.id WHERE type IN ('CALLS', 'HAS_METHOD'))
SELECT start, other, m.type AS edge_type, direction, nodes.type AS node_type FROM m JOIN nodes ON other = nodes.id""")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop in both directions over the edge types that functions have."""
    edges, nodes = trade_edges(spark, sf_dir).where(F.col("type").isin("CALLS", "HAS_METHOD")), trade_nodes(spark, sf_dir)
    some = nodes.where(F.col("id").isin("s:1", "s:2", "n:5")).select(F.col("id").alias("start"))
    to = edges.join(some, F.col("dst") == F.col("start")).select("start", F.col("src").alias("other"), F.col("type").alias("edge_type"), F.lit("TO").alias("direction"))
    back = edges.join(some, F.col("src") == F.col("start")).select("start", F.col("dst").alias("other"), F.col("type").alias("edge_type"), F.lit("FROM").alias("direction"))
    return to.unionAll(back).join(nodes.select(F.col("id").alias("other"), F.col("type").alias("node_type")), "other").select("start", "other", "edge_type", "direction", "node_type")

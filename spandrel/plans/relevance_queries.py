"""Bodies, levels, task results and run figures over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import relevance
from spandrel.plans.graph_queries import report, report_sql
from spandrel.plans.registry import query
from spandrel.sources.scan import LANGUAGES
from spandrel.sources.tables import read

STARTS = ["s:1", "s:2", "n:3"]


@query(f"SELECT start, level, count(*) AS n_nodes, count(DISTINCT type) AS n_types FROM ({report_sql(STARTS, 'backward', 2)}) WHERE level > 0 GROUP BY start, level")
def impact_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.by_level(relevance.reached(report(spark, sf_dir, STARTS, "backward", 2)))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count_if(trim(line, ' ') = '' OR starts_with(trim(line, ' '), '#')) AS n_passed, count(*) AS n_lines FROM l GROUP BY doc_id
""")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text that a reader of Python would pass over."""
    prefixes = F.array(*(F.lit(p) for lang, _, _, _, comments in LANGUAGES if lang == "python" for p in comments))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(relevance.is_comment_or_blank(F.col("line"), prefixes)).alias("n_passed"), F.count("*").alias("n_lines"))


@query("""
WITH f AS (SELECT p_brand AS c, p_type AS f, p_name AS body, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part),
o AS (SELECT c, f, body FROM (SELECT c, f, body, row_number() OVER (PARTITION BY c, f ORDER BY rn) AS r2 FROM f WHERE rn > 1) WHERE r2 = 1)
SELECT p_partkey AS id, o.body AS old_code, p_size || ' ' || n.body AS new_code
FROM part LEFT JOIN f n ON n.c = p_brand AND n.f = p_type AND n.rn = 1 LEFT JOIN o ON o.c = p_brand AND o.f = p_type WHERE p_partkey % 4 > 0
""")
def affected_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by ``Class.method`` before and after a change that put a new first function before the others."""
    part = read(spark, sf_dir, "part")
    new = part.select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("body"))
    newest = new.groupBy("class_name", "name").agg(F.min("ordinal").alias("ordinal"))
    old = new.join(newest, ["class_name", "name", "ordinal"], "left_anti")
    impact = part.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_type").alias("name"), F.col("p_size").alias("start_line"), (F.col("p_partkey") % 4).alias("level"))
    return relevance.affected_bodies(impact, old, new).select("id", "old_code", "new_code")


@query("SELECT o_orderkey AS task_id, o_orderstatus AS status, r.n AS result FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON o_orderkey = l_orderkey")
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    results = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("result"))
    return relevance.with_results(tasks, results)


@query("""
WITH t AS (SELECT event_id AS task_id, event_type AS type, CASE WHEN event_id % 5 > 0 THEN md5(CAST(user_id AS VARCHAR)) END AS input_hash FROM events)
SELECT task_id, type, input_hash FROM t WHERE input_hash IS NULL UNION ALL SELECT min(task_id), type, input_hash FROM t WHERE input_hash IS NOT NULL GROUP BY type, input_hash
""")
def task_unique_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 5 > 0, F.md5(F.col("user_id").cast("string").cast("binary"))).alias("input_hash"))
    return relevance.unique_inputs(tasks)


@query("SELECT lang, count(*) AS n_files, round(count(*) / (sum(n_chars) / 1000.0), 6) AS files_per_second, round(avg(CASE WHEN n_chars < 2000 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, max(n_chars) AS peak_memory FROM documents GROUP BY lang")
def parse_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return relevance.throughput(read(spark, sf_dir, "documents").select("lang", n.alias("elapsed_ms"), (n < 2000).alias("ok"), n.alias("memory")), "lang")

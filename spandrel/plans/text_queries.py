"""Lines, tokens, signatures, references and keys over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import scalar
from spandrel.operators import diffing, intervals, similarity
from spandrel.plans.registry import query
from spandrel.sources.tables import read

MARK = {0: "+", 1: "-", 2: " "}


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as a diff: the mark of a line depends on its length."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("hunk"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    mark = F.when(F.length("line") % 3 == 0, "+").when(F.length("line") % 3 == 1, "-").otherwise(" ")
    return d.select("hunk", "ordinal", (F.pmod("hunk", F.lit(50)) + 1).alias("new_start"), F.concat(mark, "line").alias("line"))


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"""
WITH l AS (SELECT doc_id AS hunk, line_no AS o, CASE length(line) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS m FROM {LINES_SQL}),
r AS (SELECT *, hunk % 50 + sum(CASE WHEN m = '-' THEN 0 ELSE 1 END) OVER w - CASE WHEN m = '-' THEN 0 ELSE 1 END AS row_, sum(CASE WHEN m = '+' THEN 0 ELSE 1 END) OVER w AS run FROM l WINDOW w AS (PARTITION BY hunk ORDER BY o ROWS UNBOUNDED PRECEDING))
SELECT hunk, CAST(min(row_) AS BIGINT) AS start_row, CAST(max(row_) AS BIGINT) AS end_row FROM r WHERE m = '+' GROUP BY hunk, run
""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.added_blocks(marked_lines(spark, sf_dir))


@query(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS BIGINT) AS start_offset, CAST(length(line) AS BIGINT) AS line_length FROM {LINES_SQL}")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return intervals.line_offsets(d)


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CAST(doc_id + i - 1 AS VARCHAR) || ' ' || x), chr(10))) AS numbered FROM documents")
def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(scalar.number_lines("text", F.col("doc_id"))).alias("numbered"))


@query(f"""SELECT doc_id, md5(string_agg(trim(CAST(line_no + 1 AS VARCHAR) || ': ' || line), chr(10) ORDER BY line_no)) AS content FROM (SELECT *, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS a, max(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS b FROM {LINES_SQL}) WHERE line_no BETWEEN a AND b GROUP BY doc_id""")
def trim_trailing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("trim(replace(text, '\n', '')) <> ''")
    return d.select("doc_id", F.md5(scalar.number_content("text", F.lit(1))).alias("content"))


@query("""
WITH d AS (SELECT doc_id, lang, source, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM documents),
p AS (SELECT a.doc_id AS new_id, b.doc_id AS known_id, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM d a JOIN d b ON a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id)
SELECT new_id, known_id, round(CASE WHEN n = 0 THEN 1.0 ELSE i / (n - i) END, 6) AS similarity, true AS is_similar FROM p WHERE n = 0 OR i >= 0.5 * (n - i)
""")
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    return similarity.candidates(d, d, ["lang", "source"]).withColumn("similarity", F.round("similarity", 6))


@query("SELECT p_partkey, sha256('(' || array_to_string(list_sort(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN instr(x, ':') > 0 THEN trim(substr(x, instr(x, ':') + 1)) ELSE 'any' END)), ',') || ')=>' || p_type) AS signature FROM part")
def signature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", scalar.signature_hash(F.split("p_name", " "), "p_type").alias("signature"))


@query("""
WITH r AS (SELECT page_id, replace(url, '\\', '/') || CASE WHEN page_id % 2 = 0 THEN '.ts::C::m' || page_id ELSE '' END AS ref FROM pages)
SELECT page_id, CASE WHEN regexp_matches(ref, '^(.+\\.[a-zA-Z0-9]+)::(.+)$') THEN regexp_extract(ref, '^(.+\\.[a-zA-Z0-9]+)::(.+)$', 1) ELSE ref END AS path,
  nullif(regexp_extract(ref, '^(.+\\.[a-zA-Z0-9]+)::(.+)$', 2), '') AS symbol FROM r
""")
def path_ref_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(scalar.normalize_path("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(".ts::C::m"), "page_id")).otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", ref.alias("ref")).select("page_id", scalar.reference_path("ref").alias("path"), scalar.reference_symbol("ref").alias("symbol"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_last(string_split(url, '/')) AS base FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), scalar.basename("url").alias("base"))


@query("SELECT s_suppkey, substr(regexp_replace(replace(regexp_replace('.' || s_name || ' ..x', '[^a-zA-Z0-9._-]', '_', 'g'), '..', '_'), '^\\.', '_'), 1, 100) AS key FROM supplier")
def sanitize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalar.sanitize_key(F.concat(F.lit("."), "s_name", F.lit(" ..x"))).alias("key"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(n, '^[a-zA-Z0-9_-]+$') THEN n ELSE substr(sha256(n), 1, 32) END AS identifier FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '/x' END AS n FROM customer)")
def safe_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("/x")))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("n")).select("c_custkey", scalar.safe_identifier("n").alias("identifier"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 3")
def partial_match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.where(F.from_json("props", "k long")["k"] == 3).select("event_id", "event_type")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k long")).alias("props"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events")
def map_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.map_from_entries(F.map_entries(F.from_json("props", "map<string,long>")))
    return read(spark, sf_dir, "events").select("event_id", F.explode(record).alias("key", "value"))


MESSAGES = ("Connection reset", "Repository not found", "something odd", "clone failed: DNS", "Access denied", "")
MESSAGE_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


def any_sql(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(m, '{w}')" for w in words)


@query(f"SELECT event_id, CASE WHEN {any_sql(scalar.SYSTEM_ERRORS)} THEN 'SYSTEM_ERROR' WHEN {any_sql(scalar.BUSINESS_ERRORS)} THEN 'BUSINESS_ERROR' ELSE 'SYSTEM_ERROR' END AS error_type FROM (SELECT event_id, lower({MESSAGE_SQL}) AS m FROM events)")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", scalar.error_class(F.col("event_type"), message).alias("error_type"))


@query("SELECT conv_id, turn, coalesce(role, '') || '::' || '' || '::' || coalesce(text, '') AS signature FROM conversations")
def diagnostic_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.diagnostic_signature("role", F.lit(None).cast("string"), "text").alias("signature"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - 1 AS INT) AS row_at, CAST(length(string_split(text, chr(10))[-1]) AS INT) AS column_at FROM documents")
def index_to_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column of the end of each text."""
    end = F.length("text")
    return read(spark, sf_dir, "documents").select("doc_id", scalar.row_of("text", end).alias("row_at"), scalar.column_of("text", end).alias("column_at"))


@query(f"WITH d AS (SELECT doc_id, bool_or(length(line) % 3 < 2) AS c FROM {LINES_SQL} GROUP BY doc_id) SELECT doc_id AS file, 0 AS hunk_no, CAST(doc_id % 90 + 1 AS INT) AS old_start, 1 AS old_count, CAST(doc_id % 50 + 1 AS INT) AS new_start, 3 AS new_count, c AS changed FROM d")
def hunk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches made of documents; the old count is left out and taken as 1."""
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.when(F.length(x) % 3 == 0, "+").when(F.length(x) % 3 == 1, "-").otherwise(" "), x)), "\n")
    head = F.format_string("@@ -%d +%d,3 @@\n", (F.col("doc_id") % 90 + 1), (F.col("doc_id") % 50 + 1))
    patches = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat(head, body).alias("patch"))
    found = diffing.hunks(patches)
    return found.select("file", "hunk_no", "old_start", "old_count", "new_start", "new_count", diffing.has_change().alias("changed"))


@query("SELECT page_id, CASE WHEN page_id % 3 = page_id % 2 THEN '../c' || page_id ELSE '../../a' || page_id % 2 || '/c' || page_id END AS relative FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    base = F.concat(F.lit("/src/x/../a"), (n % 3).cast("string"), F.lit("/./b"))
    path = F.concat(F.lit("/src/a"), (n % 2).cast("string"), F.lit("/c"), n.cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", scalar.relative_path(base, path).alias("relative"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPLETED' WHEN o_orderkey % 3 = 1 THEN 'UNSPECIFIED' ELSE 'PENDING' END AS shown, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS stored FROM orders")
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("COMPLETED"), F.lit("odd"), F.lit("PENDING")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    shown = scalar.read_status(status)
    return read(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), scalar.stored_status(shown).alias("stored"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 5")
def partial_match_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct("event_type", F.from_json("props", "k long").alias("props"))
    return read(spark, sf_dir, "events").where(scalar.partial_match(record, {"event_type": "click", "props": {"k": 5}})).select("event_id")


@query("SELECT p_partkey, '{\"__type\":\"Map\",\"value\":[[\"size\",\"' || p_size || '\"],[\"brand\",\"' || p_brand || '\"]]}' AS tagged, p_brand AS brand FROM part")
def tagged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = scalar.tagged_json(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")), "Map")
    return read(spark, sf_dir, "part").select("p_partkey", tagged.alias("tagged")).withColumn("brand", scalar.untagged_map("tagged")["brand"])


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS INT) AS n_words FROM documents")
def code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(scalar.words_of_code("text")).alias("n_words"))

"""Snapshot diffs, intervals, task store and sizing rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions import scalar
from spandrel.operators import diffing, graph, intervals, ordered, tasks
from spandrel.plans.registry import query
from spandrel.sources.tables import read

# Two snapshots: the last order of each customer before and since a day.
DAY = "1995-06-17"
BASE_SQL = f"""
base AS (SELECT k, max_by(v, o) AS v FROM (SELECT o_custkey AS k, o_orderpriority AS v, (o_orderdate, o_orderkey) AS o FROM orders WHERE o_orderdate < TIMESTAMP '{DAY}' AND o_custkey % 10 <> 1) GROUP BY k),
head AS (SELECT k, max_by(v, o) AS v FROM (SELECT o_custkey AS k, o_orderpriority AS v, (o_orderdate, o_orderkey) AS o FROM orders WHERE o_orderdate >= TIMESTAMP '{DAY}' AND o_custkey % 10 <> 2) GROUP BY k)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderdate", "o_orderkey")
    split = F.col("o_orderdate") < F.to_timestamp(F.lit(DAY))
    return tuple(tasks.latest(orders.where(c), "k", "o_orderdate", "o_orderkey").select("k", "v") for c in (split & (F.col("k") % 10 != 1), ~split & (F.col("k") % 10 != 2)))


@query(f"WITH {BASE_SQL} SELECT k, v FROM head WHERE k NOT IN (SELECT k FROM base)")
def snapshot_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.added(*snapshots(spark, sf_dir), "k")


@query(f"WITH {BASE_SQL} SELECT k, v FROM base WHERE k NOT IN (SELECT k FROM head)")
def snapshot_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.deleted(*snapshots(spark, sf_dir), "k")


@query(f"WITH {BASE_SQL} SELECT coalesce(b.k, h.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind FROM base b FULL JOIN head h ON b.k = h.k WHERE b.v IS DISTINCT FROM h.v")
def snapshot_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.changes(*snapshots(spark, sf_dir), "k", "v")


def spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """user_id, id, start and end in milliseconds of events of a type; an event lasts its value in minutes."""
    events = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return events.select("user_id", F.col("event_id").alias("id"), ms.alias("start"), (ms + F.floor(F.col("value") * 60_000)).cast("long").alias("end"))


def spans_sql(kind: str) -> str:
    return f"(SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 60000) AS BIGINT) AS e FROM events WHERE event_type = '{kind}')"


@query(f"SELECT user_id, id, s AS start, e AS \"end\" FROM {spans_sql('click')} c WHERE EXISTS (SELECT 1 FROM {spans_sql('view')} v WHERE v.user_id = c.user_id AND c.s <= v.e AND c.e >= v.s)")
def range_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping(spans(spark, sf_dir, "click"), spans(spark, sf_dir, "view"), "user_id")


@query(f"""SELECT id, container_id FROM (SELECT c.id, v.id AS container_id, row_number() OVER (PARTITION BY c.id ORDER BY v.e - v.s, v.id) AS rn
FROM {spans_sql('click')} c JOIN {spans_sql('view')} v ON v.user_id = c.user_id AND v.s <= c.s AND v.e >= c.e) WHERE rn = 1""")
def range_smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.smallest_container(spans(spark, sf_dir, "click"), spans(spark, sf_dir, "view"), "user_id")


MERGED_SQL = """SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= m + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {t})) GROUP BY user_id, g"""


@query(f"SELECT user_id, s AS start, e AS \"end\" FROM ({MERGED_SQL.format(gap=1, t=spans_sql('view'))})")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(spans(spark, sf_dir, "view").select("user_id", "start", "end"), "user_id")


@query(f"""
WITH r AS {spans_sql('view')}, h AS ({MERGED_SQL.format(gap=0, t=spans_sql('click'))}),
t AS (SELECT r.*, h.s AS hs, h.e AS he FROM r JOIN h ON r.user_id = h.user_id AND h.s <= r.e AND h.e >= r.s),
cut AS (SELECT *, lag(he) OVER w AS before, lead(hs) OVER w AS after FROM t WINDOW w AS (PARTITION BY user_id, id ORDER BY hs))
SELECT user_id, id, coalesce(before, s) AS start, hs AS "end" FROM cut WHERE hs > coalesce(before, s)
UNION ALL SELECT user_id, id, he, e FROM cut WHERE after IS NULL AND he < e
UNION ALL SELECT user_id, id, s, e FROM r WHERE id NOT IN (SELECT id FROM t)
""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.subtract(spans(spark, sf_dir, "view"), spans(spark, sf_dir, "click"), "user_id").select("user_id", "id", "start", "end")


@query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id * 1000 + turn) AS rn FROM conversations WHERE turn % 2 = 0) c
LEFT JOIN (SELECT role AS r, text AS t, count(*) AS n FROM conversations WHERE turn % 2 = 1 GROUP BY 1, 2) b ON c.role IS NOT DISTINCT FROM b.r AND c.text IS NOT DISTINCT FROM b.t WHERE rn > coalesce(n, 0)
""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("o", F.col("conv_id") * 1000 + F.col("turn"))
    return diffing.multiset_difference(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["role", "text"], "o").select("conv_id", "turn", "role", "text")


@query("SELECT user_id AS task_id, event_id, event_type AS status, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("status"), "value")
    return tasks.latest(events, "task_id", "ts", "event_id").select("task_id", "event_id", "status", "value")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def task_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.newest(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), 50, "ts", "event_id").drop("ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def task_events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.newest_per(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", 20, "ts", "event_id").drop("ts")


@query("""
WITH t AS (SELECT user_id AS task_id, ts AS updated_at, CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT task_id, CASE WHEN status IN ('CANCELLED', 'COMPLETED', 'FAILED') THEN 'delete' ELSE 'cancel' END AS action FROM t WHERE updated_at < (SELECT max(ts) FROM events) - INTERVAL 8 HOURS
""")
def task_stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    status = F.when(F.col("event_id") % 3 == 0, "COMPLETED").when(F.col("event_id") % 3 == 1, "IN_PROGRESS").otherwise("PENDING")
    last = tasks.latest(events, "user_id", "ts", "event_id").select(F.col("user_id").alias("task_id"), F.col("ts").alias("updated_at"), status.alias("status"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return tasks.stale_sweep(last, now)


@query("SELECT user_id AS task_id, max(event_id) AS version, arg_max(value, event_id) AS payload FROM events GROUP BY user_id")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("version"), F.col("value").alias("payload"))
    return tasks.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), "task_id", "version")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def task_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("task_id"))
    c = read(spark, sf_dir, "customer")
    return tasks.deleted(c.withColumnRenamed("c_custkey", "task_id"), gone).withColumnRenamed("task_id", "c_custkey")


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS seconds, CAST((epoch_us(ts) // 1000 % 1000) * 1000000 AS BIGINT) AS nanos FROM events")
def timestamp_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalar.timestamp_seconds("ts").alias("seconds"), scalar.timestamp_nanos("ts").alias("nanos"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_size, round(avg(n_chars), 4) AS mean_size, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS large_share FROM documents GROUP BY lang")
def file_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.sum(n).alias("total_size"), F.round(F.avg(n), 4).alias("mean_size"), F.round(F.avg(F.when(n > 2000, 1.0).otherwise(0.0)), 6).alias("large_share"))


@query("SELECT event_id, CAST(least(1000 * pow(2, event_id % 7), 10000) AS BIGINT) AS delay_ms FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalar.backoff_ms(F.col("event_id") % 7).alias("delay_ms"))


@query("""SELECT source, CAST(least(300000, greatest(30000, round(CAST(60000 AS DOUBLE) * CAST(CASE WHEN n > 100 THEN 2.5 WHEN n > 50 THEN 2.0 WHEN n > 20 THEN 1.5 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN m > 100000 OR s > 0.5 THEN 1.8 WHEN m > 50000 OR s > 0.3 THEN 1.4 ELSE 1.0 END AS DOUBLE)))) AS BIGINT) AS timeout_ms
FROM (SELECT source, count(*) AS n, avg(n_chars) AS m, avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END) AS s FROM documents GROUP BY source)""")
def timeout_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"), F.avg(F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.0)).alias("s"))
    return d.select("source", scalar.adaptive_timeout_ms(F.col("n"), F.col("m"), F.col("s")).alias("timeout_ms"))


@query("""
WITH b AS (SELECT event_id, greatest(20, least(user_id % 20 * 8, 100)) AS x, event_id * 7 % 30000 AS n, value / 100 AS h FROM events),
c AS (SELECT *, CASE WHEN n > 20000 THEN least(x, 30) WHEN n > 10000 THEN least(x, 40) WHEN n > 5000 THEN least(x, 50) ELSE x END AS y FROM b)
SELECT event_id, CAST(CASE WHEN h > 0.8 THEN greatest(5, floor(y * 0.6)) WHEN h > 0.6 THEN greatest(8, floor(y * 0.8)) ELSE y END AS BIGINT) AS batch_size FROM c
""")
def batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalar.batch_size(F.col("user_id") % 20, F.col("event_id") * 7 % 30000, F.col("value") / 100).alias("batch_size"))


@query("SELECT source, doc_id, CAST((rn - 1) // 10 AS BIGINT) AS chunk, round(100.0 * rn / n, 6) AS progress FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are a running count, which large sources take range by range."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id")
    ranked = ordered.scan(ordered.cut(d, ["source"], ["doc_id"]), ["source"], ["doc_id"], rn=("sum", F.lit(1).cast("long")))
    sizes = d.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"))
    n = ranked.join(ordered.few(sizes), F.col("source").eqNullSafe(F.col("_s")))
    return n.select("source", "doc_id", F.floor((F.col("rn") - 1) / 10).alias("chunk"), F.round(F.lit(100.0) * F.col("rn") / F.col("n"), 6).alias("progress"))


#: A value counts half as much as the one after it: before so many, doubles of any size that occur add nothing.
HALVINGS = 1100


@query("SELECT user_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(value ORDER BY event_id)), lambda a, x: (a + x) / 2), 6) AS mean FROM events GROUP BY user_id")
def exp_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last mean and a value is a sum of values over powers of two, so a user's last values are summed and no list is kept."""
    last = tasks.newest_per(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", HALVINGS, "event_id", rank="rank")
    return last.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.pow(F.lit(0.5), F.col("rank"))), 6).alias("mean"))


@query("""
WITH f AS (SELECT doc_id AS id, doc_id AS created, n_chars AS size, (SELECT max(doc_id) FROM documents) - 150 AS oldest FROM documents),
k AS (SELECT id, sum(size) OVER (ORDER BY created DESC, id DESC ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE created >= oldest)
SELECT id FROM f WHERE created < oldest UNION ALL SELECT id FROM k WHERE total > 200000
""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created"), F.col("n_chars").alias("size"))
    return tasks.evicted(d, F.lit(d.agg(F.max("id")).first()[0]), 150, 200_000)


@query("SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'delete' ELSE 'cancel' END AS action, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("purchase", "signup"), "delete").otherwise("cancel")
    return read(spark, sf_dir, "events").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS key, arg_max(o_orderkey, o_orderkey) AS value FROM orders GROUP BY o_orderpriority")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("ordinal"))
    return graph.merge_snapshots(o, "key").select("key", "value")


# Extensions: relational forms beyond the code graph that the same tables support.


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extension_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def extension_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"))

"""Streaming queries over events, drained and compared with their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.scalar import TERMINAL
from spandrel.operators import tasks
from spandrel.operators.storage import shared_folder
from spandrel.plans.registry import query
from spandrel.sources.tables import read
from spandrel.streaming import machine, streams


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.source(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")), "complete")


@query("SELECT user_id AS task_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended events, and the latest state as a view of them."""
    log = streams.drain(events(spark, sf_dir).select(F.col("user_id").alias("task_id"), "event_id", F.col("event_type").alias("status")))
    return tasks.latest(log, "task_id", "event_id")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM e)
SELECT user_id, min(ts) AS burst_start, CAST(count(*) AS BIGINT) AS n, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM s GROUP BY user_id, burst
HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES
""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return streams.drain(streams.debounced(e, "user_id", "ts", "30 minutes", "10 minutes", "ts")).withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE c AS (SELECT user_id AS u, event_id AS id, (epoch_us(ts) // 1000) AS ms, value > 95 AS ok, event_type = 'view' AS business, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
s AS (SELECT u, 0::BIGINT AS rn, NULL::BIGINT AS id, 'CLOSED' AS name, 0::BIGINT AS f, 0::BIGINT AS o, 0::BIGINT AS k FROM (SELECT DISTINCT u FROM c)
  UNION ALL SELECT u, rn, id,
    CASE WHEN shut OR business THEN now WHEN ok THEN CASE WHEN now = 'HALF_OPEN' THEN 'CLOSED' ELSE now END WHEN now = 'HALF_OPEN' OR f >= 9 THEN 'OPEN' ELSE now END,
    CASE WHEN shut OR business THEN f WHEN ok THEN 0 ELSE f + 1 END, CASE WHEN NOT shut AND NOT business AND NOT ok AND (now = 'HALF_OPEN' OR f >= 9) THEN ms ELSE o END, 0
  FROM (SELECT c.u, c.rn, c.id, c.ms, c.ok, c.business, s.f, s.o, s.name = 'OPEN' AND c.ms - s.o < 15000 AS shut, CASE WHEN s.name = 'OPEN' AND c.ms - s.o >= 15000 THEN 'HALF_OPEN' ELSE s.name END AS now FROM s JOIN c ON c.u = s.u AND c.rn = s.rn + 1))
SELECT u AS key, id, name AS state FROM s WHERE rn > 0
""")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user's circuit breaker after each event; low values are failures."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    calls = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("at_ms"), (F.col("value") > 95).alias("ok"), (F.col("event_type") == "view").alias("business"))
    return streams.drain(streams.breaker(calls))


#: Moves that kinds of events stand for.
MOVES = {"signup": "start", "view": "pause", "click": "resume", "purchase": "complete", "error": "fail"}


def moved_tasks(e: DataFrame) -> DataFrame:
    """Events as moves of their users' tasks."""
    names = F.create_map(*(F.lit(x) for p in MOVES.items() for x in p))
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("task_id"), "event_id", F.unix_millis(ts).alias("at_ms"), F.try_element_at(names, F.col("event_type")).alias("event"), ts.alias("ts"))


ENDED_SQL = "(" + ", ".join(f"'{s}'" for s in TERMINAL) + ")"
NEXT_SQL = "MAP {" + ", ".join(f"'{s}>{e}': '{t}'" for (s, e), t in tasks.TRANSITIONS.items()) + "}"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS id, (epoch_us(ts) // 1000) AS ms, MAP {MOVES}[event_type] AS ev, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
s AS (SELECT u, 0 AS rn, NULL::VARCHAR AS status, NULL::BIGINT AS upd, NULL::BIGINT AS id, NULL::BIGINT AS ms, NULL::VARCHAR AS ev, NULL::VARCHAR AS was, NULL::BIGINT AS since, NULL::VARCHAR AS kind FROM (SELECT DISTINCT u FROM e)
  UNION ALL SELECT u, rn, CASE WHEN nxt IS NOT NULL THEN nxt ELSE now END, CASE WHEN nxt IS NOT NULL THEN ms ELSE now_upd END, id, ms, ev, status, upd, CASE WHEN nxt IS NOT NULL THEN 'moved' ELSE 'illegal' END
  FROM (SELECT *, {NEXT_SQL}[coalesce(now, 'PENDING') || '>' || ev] AS nxt FROM (SELECT e.*, s.status, s.upd,
    CASE WHEN s.status IS NULL OR s.upd + 28800000 > e.ms THEN s.status WHEN s.status IN {ENDED_SQL} OR s.upd + 57600000 <= e.ms THEN NULL ELSE 'CANCELLED' END AS now,
    CASE WHEN s.status IS NULL OR s.upd + 28800000 > e.ms THEN s.upd WHEN s.status IN {ENDED_SQL} OR s.upd + 57600000 <= e.ms THEN NULL ELSE s.upd + 28800000 END AS now_upd
    FROM s JOIN e ON e.u = s.u AND e.rn = s.rn + 1))),
idle AS (SELECT u, was AS status, since AS upd, ms AS now FROM s WHERE was IS NOT NULL
  UNION ALL SELECT u, status, upd, (SELECT max(ms) - 600000 FROM e) FROM (SELECT *, max(rn) OVER (PARTITION BY u) AS top FROM s) WHERE rn = top AND status IS NOT NULL)
SELECT u AS task_id, ms AS at_ms, id AS event_id, kind, ev AS event, status FROM s WHERE rn > 0
UNION ALL SELECT u, upd + 28800000, NULL, CASE WHEN status IN {ENDED_SQL} THEN 'deleted' ELSE 'cancelled' END, 'idle', CASE WHEN status IN {ENDED_SQL} THEN NULL ELSE 'CANCELLED' END FROM idle WHERE upd + 28800000 <= now
UNION ALL SELECT u, upd + 57600000, NULL, 'deleted', 'idle', NULL FROM idle WHERE status NOT IN {ENDED_SQL} AND upd + 57600000 <= now
""")
def stream_task_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves, illegal moves, and what eight idle hours do to each user's task."""
    return with_rocks(spark, lambda: streams.drain(machine.moves(moved_tasks(events(spark, sf_dir)))))


def with_rocks(spark: SparkSession, f):
    """f() with the state store that timers need."""
    before = spark.conf.get(machine.STORE)
    spark.conf.set(machine.STORE, machine.ROCKS)
    try:
        return f()
    finally:
        spark.conf.set(machine.STORE, before)


@query("""
WITH d AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1)
SELECT week::VARCHAR AS week, CASE WHEN n % 2 = 0 THEN n END AS n, CASE WHEN n % 2 = 0 THEN ids::BIGINT END AS ids, n % 2 = 1 AS failed FROM d
""")
def stream_failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch a week; a week with an odd number of events fails, and its file is in the ledger."""
    e = read(spark, sf_dir, "events").select("event_id", "value", F.to_date(F.date_trunc("week", "ts")).alias("week"))
    weeks = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e.repartition("week").write.partitionBy("week").parquet(weeks)

    def work(batch: DataFrame) -> DataFrame:
        if batch.count() % 2:
            raise ValueError("an odd number of events")
        return batch.groupBy(F.col("week").cast("string").alias("week")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))

    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(weeks)
    done, ledger = streams.attempted(stream, work, "week string, n long, ids long")
    lost = ledger.select(F.explode("files").alias("file")).select(F.regexp_extract("file", r"week=([0-9-]+)", 1).alias("week"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("ids"), F.lit(True).alias("failed"))
    return done.withColumn("failed", F.lit(False)).unionByName(lost)

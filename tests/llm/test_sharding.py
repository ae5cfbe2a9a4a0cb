import zlib
from collections import Counter, defaultdict

from helpers import DATA

from spandrel.llm import sharding

SCHEMA = "doc_id long, text string, key string, shard int"


def check(rows, got, shards=8):
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(size.values()) / shards, max((r["size"] for r in got), default=0)
    assert all(abs(size[k] - mean) <= most for k in range(shards))


def test_sizes_slots_and_hot_groups(spark):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(600)] + [(1000 + i, "hot " * 30) for i in range(500)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    for range_rows, least in ((sharding.RANGE_ROWS, 32), (20, 4)):
        check(rows, [r.asDict() for r in sharding.shard(docs, range_rows=range_rows, least=least).collect()])


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    rows = [(i, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    monkeypatch.setattr(sharding, "DRAWS", 1)
    check(rows, [r.asDict() for r in sharding.shard(docs, least=16).collect()])


def test_driver_tables_and_files(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], [r.asDict() for r in sharding.shard(docs).collect()])
    sharding.write_shards(docs, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()


def test_one_text_larger_than_a_shard_and_bytes_within_the_tolerance(spark):
    check([(0, "x" * 300_000), *((i, f"y{i}") for i in range(1, 50))], [r.asDict() for r in sharding.shard(spark.createDataFrame([(0, "x" * 300_000, "k", 1), *((i, f"y{i}", "k", 1) for i in range(1, 50))], SCHEMA)).collect()])
    rows = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE repeat(concat('t', id), CAST(id % 7 AS INT)) END AS text", "'k' AS key", "1 AS shard")
    size = {r.shard: r.b for r in sharding.shard(rows).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(b - mean) <= 2 * sharding.TOLERANCE * mean for b in size.values())


def test_shards_are_runs_of_keys_cut_at_splitters(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = spark.createDataFrame(sharding.records(docs).collect(), "doc_id long, size long, text_crc32 long, key long")
    n, total = rows.count(), rows.agg({"size": "sum"}).first()[0]
    splitters, first, count = sharding.split(rows, n, total, 8, 64, sharding.TOLERANCE)
    keys = sorted((r.key, r.size) for r in rows.collect())
    assert list(splitters) == sorted(set(splitters)) and {int(s) for s in splitters} <= {k for k, _ in keys} | {k - 1 for k, _ in keys}
    assert sum(count) == n and len(first) == 8
    ends = [splitters[f - 1] for f in first[1:]]
    bytes_of = [sum(b for k, b in keys if lo < k <= hi) for lo, hi in zip([-(2**63) - 1, *ends], [*ends, 2**63], strict=True)]
    most = max(b for _, b in keys)
    assert all(abs(b - total / 8) <= max(most, 2 * sharding.TOLERANCE * total / 8) for b in bytes_of)


def test_small_and_empty_tables(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    check([(1, "x")], [r.asDict() for r in sharding.shard(spark.createDataFrame([(1, "x", None, None)], SCHEMA)).collect()])


def test_many_small_equal_records_do_not_crowd_a_range(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN CAST(NULL AS STRING) ELSE repeat(concat('t', id), 30) END AS text", "'k' AS key", "1 AS shard")
    made = spark.createDataFrame(sharding.records(rows).collect(), "doc_id long, size long, text_crc32 long, key long")
    n, total = made.count(), made.agg({"size": "sum"}).first()[0]
    _, _, count = sharding.split(made, n, total, 8, 32, sharding.TOLERANCE, 500)
    assert count.sum() == n and count.max() <= 1000
    check([(r.doc_id, r.text) for r in rows.collect()], [r.asDict() for r in sharding.shard(rows, range_rows=500, least=32).collect()])

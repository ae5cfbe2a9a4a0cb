import hashlib
import random

import numpy as np
import pytest
from helpers import DATA, same, sql_rows
from pyspark.sql import functions as F

from spandrel.llm import exact_dedup as ed
from spandrel.llm import queries

SCHEMA = "doc_id long, text string, digest string, row int, shard string, old int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, None, 1) for i, t in rows], SCHEMA)


def check(rows, got):
    members = {}
    for i, t in rows:
        members.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    kept = {}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in members.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert kept == dict.fromkeys(by_sha, 1)
    assert sorted(str(i) for i, _ in rows) == sorted(str(r["doc_id"]) for r in got)


ROWS = [(1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (4, ""), (None, "lonely"), (None, "twice"), (None, "twice"), (5, "A"), (6, "a "), (-7, "x" * 300_000), (-9, "x" * 300_000), (8, "x" * 299_999), (-(2**63), "least"), (None, "least")]


@pytest.mark.parametrize("history", ["true", "false", "doc_id is null", "doc_id % 2 = 0", "cast(null as boolean)"])
def test_every_split_into_history_and_new_rows(spark, monkeypatch, history):
    monkeypatch.setattr(ed, "KEYS", 4)
    check(ROWS, [r.asDict() for r in ed.dedup(frame(spark, ROWS), F.expr(history)).collect()])


def test_hot_groups_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ed, "KEYS", 50)
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(2500)}") for i in range(6000)]
    check(rows, [r.asDict() for r in ed.dedup(frame(spark, rows), F.expr("doc_id < 2000")).collect()])


def test_hash_is_minimal_and_perfect_and_checks_bytes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 5000):
        held = rng.integers(0, 256, (n, 32), np.uint8)
        sizes, bits, order = ed.build(held)
        assert sorted(order) == list(range(n))
        held = held[order]
        assert ed.slots(held, sizes, bits, held).tolist() == list(range(n))
        others = rng.integers(0, 256, (4000, 32), np.uint8)
        assert (ed.slots(others, sizes, bits, held) == -1).all()
        if n:  # other bytes behind the same 64 bits that the hash sees
            twins = held.copy()
            twins[:, 31] ^= 1
            assert (ed.slots(twins, sizes, bits, held) == -1).all()


def test_digests_with_equal_hash_bits_are_listed():
    same_bits = np.zeros((5, 32), np.uint8)
    same_bits[:, 31] = range(5)
    other = np.full((1, 32), 9, np.uint8)
    all_of = np.concatenate([same_bits[:4], other])
    sizes, bits, order = ed.build(all_of)
    held = all_of[order]
    assert sorted(ed.slots(all_of, sizes, bits, held).tolist()) == list(range(5))
    assert ed.slots(same_bits[4:], sizes, bits, held).tolist() == [-1]


def test_slots_hold_digest_and_winner(spark):
    rows = [(k, f"t{k % 40}") for k in range(100)]
    docs = frame(spark, rows).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(0).alias("shard"), F.col("doc_id").alias("row"))
    (shard,) = ed.index(ed.groups(docs)).collect()
    assert len(shard["digests"]) == 32 * 40 == 32 * len(shard["ids"])
    for k, (i, n) in enumerate(zip(shard["ids"], shard["counts"], strict=True)):
        digest = hashlib.sha256(f"t{i % 40}".encode()).digest()
        assert bytes(shard["digests"][32 * k : 32 * k + 32]) == digest and i == max(j for j, t in rows if t == f"t{i % 40}") and n == sum(t == f"t{i % 40}" for _, t in rows)


def test_query_against_sql(spark):
    same(queries.op11_exact_dedup(spark, str(DATA / "sf0.001")), sql_rows(ed.SQL))


def test_empty_table(spark):
    assert ed.dedup(frame(spark, []), F.lit(True)).count() == 0

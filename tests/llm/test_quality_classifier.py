import random

from helpers import DATA

from spandrel.llm import quality_classifier as qc

SCHEMA = "doc_id long, text string, key double, good string"


def test_top_k_against_sorting(spark):
    rng = random.Random(1)
    rows = [(i % 480, None, float(rng.choice([rng.random(), 0.5])), "x") for i in range(500)]
    scored = spark.createDataFrame(rows, SCHEMA)
    for k in (0, 1, 77, 250, 499, 500):
        for below in (100_000, 20):
            kept = qc.top_k(scored, k, "key", "doc_id", below).where("kept").collect()
            want = sorted(rows, key=lambda r: (-r[2], r[0]))[:k]
            # Rows of equal key and id stand or fall together.
            assert {(r.key, r.doc_id) for r in kept} == {(r[2], r[0]) for r in want}


def corpus():
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(20)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(good, k=rng.randrange(20, 80))
        is_bad = i % 4 == 0
        if is_bad:
            words[::5] = rng.choices(bad, k=len(words[::5]))
        docs.append((i, " ".join(words), 1.0, "x"))
        if i % 3 == 0:
            labels.append((i, int(not is_bad), 0))
    return docs, labels


def test_separates_and_draws_the_share(spark):
    docs, labels = corpus()
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "g1 " * 30_000, None, None)]
    labels += [(0, 0, 1), (9999, 1, 0), (None, 1, 0)]
    got = {r.doc_id: r.kept for r in qc.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert set(got) == {d[0] for d in docs}
    clean = [i for i in range(600) if i % 4]
    assert sum(got[i] for i in range(600) if i % 4 == 0) <= 6
    assert sum(got[i] for i in clean) >= len(clean) - 60


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", None, None), (1, "a b", None, None), (None, "c", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in qc.classify(docs, none).collect()] == [True] * 3
    assert qc.classify(docs.limit(0), none).count() == 0


def test_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = qc.classify(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg({"*": "count"}).collect()
    assert sum(r["count(1)"] for r in kept) == labels.count()
    verdict = {r.doc_id: r.kept for r in qc.classify(docs, labels).collect()}
    good = [verdict[r.doc_id] for r in labels.where("quality = 1 and toxic = 0").collect()]
    bad = [verdict[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert sum(good) >= 0.85 * len(good) and sum(bad) <= 0.15 * len(bad)

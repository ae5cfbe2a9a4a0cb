import itertools
import math
import random

import pandas as pd
from helpers import DATA, same, sql_rows

from spandrel.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string"


def fixture():
    item = [f"Item{i}" for i in range(30)]
    other = [f"o{i}" for i in range(200)]
    swapped = [w if i % 6 else "x" for i, w in enumerate(item)]
    texts = [None, "", "a b c", " ".join(other), " ".join(other[:50] + item + other[50:]), " ".join(swapped).lower(), " ".join(item[:9] + other), "\n".join(item[9:23]), " ".join(w if i % 2 else "x" for i, w in enumerate(item)), " ".join(other * 100 + item), " ".join([*item, *item]), "p q r s t u v w"]
    docs = [(i, t, 7) for i, t in enumerate(texts)] + [(4, " ".join(other), 7), (None, " ".join(item), 7)]
    items = [(1, " ".join(item)), (2, "p q r s t u v w"), (3, "a b c"), (4, None), (5, " ".join(item)), (None, " ".join(other))]
    return docs, items


def test_verdicts_and_sql(spark):
    docs, items = fixture()
    for bound in (dc.MAX_BROADCAST, 0):
        got = dc.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), bound)
        bad = {r.doc_id for r in got.collect() if r.contaminated}
        assert bad == {2, 4, 5, 7, 9, 10, 11}
    longer = dc.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_words=7)
    assert {r.doc_id for r in longer.collect() if r.contaminated} == {4, 5, 7, 9, 10, 11}
    views = {"documents": pd.DataFrame(docs, columns=["doc_id", "text", "item_id"]).astype({"doc_id": "Int64"}), "benchmark": pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}).dropna(subset="item_id")}
    same(got, sql_rows(dc.SQL, views=views))


def test_driver_tables(spark):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    same(dc.judge(docs, items), sql_rows(dc.SQL))


def test_clean_keeps_columns(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, DOCS)
    kept = dc.clean(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 3, 6, 8]


def test_empty_tables(spark):
    docs, items = fixture()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.judge(none[0], spark.createDataFrame(items, ITEMS)).count() == 0
    assert not dc.judge(spark.createDataFrame(docs, DOCS), none[1]).where("contaminated").count()


def test_every_alignment_that_agrees_has_a_seed():
    for n in range(1, dc.WINDOW + 1):
        masks = next(m for least, most, m in dc.MASKS if least <= n <= most)
        placed = [{i + o for o in m} for m in masks for i in range(n - m[-1])]
        for other in itertools.combinations(range(n), n - math.ceil(n * dc.AGREE)):
            assert any(p.isdisjoint(other) for p in placed), (n, other)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [[f"i{k}w{i}" for i in range(n)] for k, n in enumerate([13, 13, 15, 20, 8, 7, 10, 12, 6, 5, 4, 3, 1])]
    texts = []
    for k, item in enumerate(items):
        n = min(13, len(item))
        patterns = [p for s in range(n - math.ceil(n * dc.AGREE), n - math.ceil(n * dc.AGREE) + 2) for p in itertools.combinations(range(n), s)]
        for p in [(5, 6), (6, 7)] * (n == 13) + rng.sample(patterns, min(40, len(patterns))):
            at = rng.randrange(len(item) - n + 1)
            texts.append([f"a{i}" for i in range(9)] + [f"x{i}" if i in p else w for i, w in enumerate(item[at : at + n])] + [f"b{i}" for i in range(9)])

    def leaks(w, x):
        n = min(13, len(x))
        return any(sum(a == b for a, b in zip(w[i : i + n], x[j : j + n], strict=True)) >= math.ceil(n * dc.AGREE) for i in range(len(w) - n + 1) for j in range(len(x) - n + 1))

    docs = spark.createDataFrame([(i, " ".join(t), 7) for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], ITEMS)
    for least in (7, 1):
        kept = {r.doc_id for r in dc.clean(docs, benchmark, least).collect()}
        assert kept == {i for i, t in enumerate(texts) if not any(leaks(t, x) for x in items if len(x) >= least)}
    frames = {"documents": pd.DataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], columns=["doc_id", "text"]), "benchmark": pd.DataFrame([(k, " ".join(x)) for k, x in enumerate(items)], columns=["item_id", "text"])}
    same(dc.judge(docs, benchmark), sql_rows(dc.SQL, views=frames))

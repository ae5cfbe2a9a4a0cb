import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import cache

from helpers import DATA

from spandrel.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in li.identify(docs, li.fit(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_against_plain_counts(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [r for r in docs.collect() if r.text is not None]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    tables = [defaultdict(Counter) for _ in range(6)]  # by size, language: counts
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in words(r.text):
                tables[0][r.lang][w] += 1
                for n in range(1, 6):
                    tables[n][r.lang].update(f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted(tables[0])

    def rate(size, key):
        total = {x: sum(tables[size][x].values()) for x in langs}
        return [math.log(tables[size][x][key] / total[x]) if tables[size][x][key] else -1 - math.log(total[x]) for x in langs]

    def score(w):
        if any(tables[0][x][w] for x in langs):
            return rate(0, w)
        for n in range(5, 0, -1):
            known = [rate(n, k) for i in range(len(w) + 3 - n) if any(tables[n][x][k := f"^{w}$"[i : i + n]] for x in langs)]
            if known:
                return [sum(c) / len(known) for c in zip(*known, strict=True)]
        return [0] * len(langs)

    memo = {}
    rate = cache(rate)
    got = {r.doc_id: r for r in li.identify(docs, li.fit(docs)).collect()}
    for r in rows[:60]:
        found = words(r.text)
        if not found:
            assert got[r.doc_id].lang_pred == "und"
            continue
        for w in set(found) - set(memo):
            memo[w] = score(w)
        sums = [sum(memo[w][i] for w in found) for i in range(len(langs))]
        best = max(range(len(langs)), key=lambda i: sums[i])
        odds = [math.exp((s - sums[best]) / math.sqrt(len(found))) for s in sums]
        assert got[r.doc_id].lang_pred == langs[best] and abs(got[r.doc_id].score - 1 / sum(odds)) < 1e-4


def test_odd_rows(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("der die das haus", "de")] * 9 + [("the of and house", "en")] * 9 + [(None, "de"), ("", None), ("12 34 ²", "de"), ("hausen", None), ("THE x", None), ("the " * 50_000, None)])] + [(None, "of", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in li.identify(docs, li.fit(docs)).collect()}
    assert [got[i].lang_pred for i in range(18, 24)] == ["und", "und", "und", "de", "en", "en"]
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert got[18].score == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.identify(docs, li.fit(docs)).collect()] == ["und"]
    none = docs.limit(0)
    assert li.identify(none, li.fit(none)).count() == 0


def test_a_model_in_a_worker_is_small_and_scores_are_looked_up_together(spark, monkeypatch):
    """Each worker of an executor loads the model; keys as Python strings in dicts took several times these bytes."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = li.fit(docs)
    n, data = len(model.rates), pickle.dumps(model, 5)
    tracemalloc.start()
    loaded = pickle.loads(data)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(loaded.rates) == n > 10_000 and held < 60 * n
    want = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs, model).collect()}
    monkeypatch.setattr(li, "NEW_WORDS", 5)
    monkeypatch.setattr(li, "REMEMBERED", 300)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs, model).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)

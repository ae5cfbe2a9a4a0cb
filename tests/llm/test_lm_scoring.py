import math
import random
from collections import Counter

import pandas as pd
import pytest
from helpers import DATA, sql_rows

from spandrel.llm import lm_scoring

SCHEMA = "doc_id long, text string, score double, bucket int"


def close(df, rows):
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == {r["doc_id"] for r in rows} and len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]].n_words == r["n_words"]
        assert got[r["doc_id"]].score == pytest.approx(r["score"], abs=2e-4), r


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "w1", "w1 w2", "w1 w2"] + [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randrange(1, 200))) for _ in range(60)]
    return [*out, "w1 w2 " * 20_000, "a" * 5000 + " w1", "w7 " + "b" * 5000]


@pytest.mark.parametrize("sizes", [(500_000, 65_536), (64, 16), (0, 0)])
def test_against_sql(spark, sizes):
    rows = list(enumerate(texts())) + [(None, "w1 w9"), (7, "w1 w3")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], SCHEMA)
    expected = sql_rows(lm_scoring.SQL, views={"documents": pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})})
    close(lm_scoring.score(docs, None, 2, *sizes), expected)


def brute(rows, corpus, order):
    """Stupid backoff as it is defined, by recursion."""
    c, total = Counter(), 0
    for t in corpus:
        w = (t or "").encode().split()
        total += len(w)
        c.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))

    def s(g):
        if len(g) == 1:
            return math.log(max(1, c[g]) / total)
        return math.log(c[g] / c[g[:-1]]) if c[g] else math.log(0.4) + s(g[1:])

    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        out.append({"doc_id": i, "n_words": len(w), "score": sum(s(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w)))})
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_of_other_texts(spark, order):
    rows = list(enumerate(texts()))
    frame = lambda r: spark.createDataFrame([(i, t, 1.0, 2) for i, t in r], SCHEMA)
    for sizes in ((500_000, 65_536), (50, 10)):
        close(lm_scoring.score(frame(rows[1::2]), frame(rows[::2]), order, *sizes), brute(rows[1::2], [t for _, t in rows[::2]], order))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_under_the_documents_themselves(spark, order):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], SCHEMA)
    for sizes in ((65_536, 262_144), (20, 10)):
        close(lm_scoring.score(docs, None, order, *sizes), brute(rows, [t for _, t in rows], order))


def test_many_different_words(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(1_000_000)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 10_000 : (i + 1) * 10_000] + words[:5])) for i in range(100)]
    expected = sql_rows(lm_scoring.SQL, views={"documents": pd.DataFrame(rows, columns=["doc_id", "text"])})
    close(lm_scoring.score(spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], SCHEMA), None, 2, 1000, 1000), expected)


def test_driver_tables(spark):
    close(lm_scoring.score(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")), sql_rows(lm_scoring.SQL))


def test_empty_table(spark):
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0

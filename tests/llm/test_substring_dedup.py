import hashlib
import random

import pandas as pd
from helpers import DATA, same, sql_rows

from spandrel.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, gram string"


def brute(rows, n):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if i is not None:
                low[g] = min(low.get(g, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and low[tuple(w[k : k + n])] < i for j in range(n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(2)
    word = lambda: rng.choice(["la", "le", "é", "x.", "of"]) + str(rng.randrange(400))
    passage = [word() for _ in range(70)]
    texts = [None, "", "short text", " ".join(passage), " ".join(passage)]
    for _ in range(20):
        filler = [word() for _ in range(rng.randrange(5, 120))]
        cut = rng.randrange(len(filler))
        texts.append("\n".join(filler[:cut] + passage[rng.randrange(25) : rng.randrange(45, 71)] + filler[cut:]))
    texts += ["a " * 130, "a " * 60, "b a " * 80, "a b " * 60]
    return [(i, t) for i, t in enumerate(texts)] + [(3, " ".join(passage[5:])), (9, " ".join(passage)), (None, " ".join(passage))]


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    for n, part in ((50, 8), (12, 5)):
        assert sorted((tuple(r) for r in sd.dedup(docs, n, part).collect()), key=str) == brute(rows, n)
    same(sd.dedup(docs).drop("kept_text"), sql_rows(sd.SQL, views={"documents": pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})}))


def test_long_words_that_differ(spark):
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    a, b = "".join("xy"[k] for k in bits), "".join("yx"[k] for k in bits)
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}"), (4, "z" * 100_000 + " " + rest), (5, f"{rest} {a} " * 400), (6, " ".join(f"u{i}" for i in range(40_000)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in sd.dedup(docs).collect()), key=str) == brute(rows, 50)


def test_driver_tables(spark):
    same(sd.dedup(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).drop("kept_text"), sql_rows(sd.SQL))


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).count() == 0

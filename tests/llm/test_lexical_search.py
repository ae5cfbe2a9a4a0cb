import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, same, sql_rows

from spandrel.llm import lexical_search as ls
from spandrel.llm import queries

DOCS, ITEMS = "doc_id long, text string, score int, rank string, item_id long", "item_id long, text string, doc_id long, terms int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(c > 0 for _, _, c in held), sum(c for _, _, c in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, length in held:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * length * n // total))) for t in set(terms(text)) if c[t])
            scores += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    most = more.pop("most", ls.SHARD_BYTES)
    table = ls.index(spark.createDataFrame([(i, t, 1, "x", 5) for i, t in docs], DOCS), most)
    return sorted((tuple(r) for r in ls.search(table, spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS), **more).collect()), key=str)


def some(seed, n):
    rng = random.Random(seed)
    words = [f"{c}{k}" for k in range(60) for c in "aÉß"]
    pick = lambda size: " ".join(rng.choice(words[: rng.choice((3, 20, 180))]) + rng.choice(["", ".", " ", "_"]) for _ in range(size))
    return [(i, pick(rng.randrange(60))) for i in rng.sample(range(-n, 3 * n), n)], [(k, pick(rng.randrange(1, 25))) for k in range(15)]


@pytest.mark.parametrize("most", [60, 2000, ls.SHARD_BYTES])
def test_against_brute_force_in_few_and_many_shards(spark, most):
    docs, items = some(most, 400)
    assert found(spark, docs, items, most=most) == brute(docs, items)
    assert found(spark, docs, items, most=most, top=3, block_terms=40) == brute(docs, items, 3)


def test_ties_repeats_nulls_and_odd_texts(spark):
    docs = [(k, "same words here") for k in range(30, 0, -1)] + [(7, "same words here")] * 2 + [(None, "same words here"), (None, None), (50, ""), (51, " \n\x00,;"), (52, "SAME Words HERE"), (53, "sames İstanbul ÀB àb Àb"), (54, "w " * 200_000 + "needle"), (55, "x" * 300_000)]
    items = [(1, "same"), (1, "same"), (2, None), (3, ""), (4, "nothing"), (None, "needle words"), (5, "Àb İstanbul sameS"), (6, "x" * 300_000), (7, "here here, words!")]
    for most in (1, 500, ls.SHARD_BYTES):
        assert found(spark, docs, items, most=most) == brute(docs, items)
    assert found(spark, [(None, "only"), (None, "only one"), (3, "only")], [(1, "only one")]) == brute([(None, "only"), (None, "only one"), (3, "only")], [(1, "only one")])


def test_a_term_that_every_document_holds(spark):
    docs = [(k, "hot " * (k % 5 + 1) + f"t{k % 7}") for k in range(900)]
    items = [(1, "hot"), (2, "hot t3"), (3, "t3 t4 hot")]
    assert found(spark, docs, items, most=3000) == brute(docs, items)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    values = np.concatenate([[0, 1, 127, 128, 2**14 - 1, 2**14, 2**62], rng.integers(0, 2**40, 500)])
    raw, ends = ls.packed(values)
    assert ls.unpacked(raw).tolist() == values.tolist() and ends[-1] == len(raw)
    assert len(ls.unpacked(ls.packed(values[:0])[0])) == 0


def test_query_against_sql(spark):
    same(queries.op13_ranked_lexical_search(spark, str(DATA / "sf0.001")), sql_rows(ls.SQL))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []

import random

import numpy as np
import xxhash

from spandrel.llm import simhash
from spandrel.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, linked):
    """Smallest id reachable, by repeated relaxation over all pairs."""
    best = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if linked(prints[a], prints[b]) and best[b] < best[a]:
                    best[a] = best[b]
    return best


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 400))) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "one two", "One Two", "one two three"]
    for text in base:
        words = text.split()
        texts += [text, text.upper(), text.replace(" ", "\n", 3)]
        for _ in range(3):
            w = list(words)
            w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    return texts


def test_contract_against_brute_force(spark):
    texts = corpus()
    rows = [(i * 7 + 3, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    assert {i: r.f0 % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def test_trie_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 7), False)) for _ in range(600)], np.uint64)
    a = np.sort(np.unique(np.concatenate([base, rng.choice(base, 600) ^ flips])))
    for budget in (0, 3, 4):
        for chunk in (7, 1 << 17):
            got = {(int(i), int(j)) for x in simhash.trie_pairs(a, None, 32, budget, chunk=chunk) for i, j in zip(*x, strict=True)}
            assert got == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= budget}
    b = a[::2] ^ np.uint64(5)
    b.sort()
    got = {(int(i), int(j)) for x in simhash.trie_pairs(a, b, 32, 3) for i, j in zip(*x, strict=True)}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 3}


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(11)
    texts = corpus()
    for text in list(texts[7:40:3]):
        words = text.split()
        for _ in range(4):
            w = list(words)
            for _ in range(max(1, len(w) * rng.randrange(1, 7) // 100)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **simhash.SIMILAR).collect()}
    want = classes({i: shingles(t) for i, t in enumerate(texts)}, alike)
    want[1] = want[2] = 0  # no words: equal fingerprints
    assert {i: r.component_id for i, r in got.items()} == want
    for text in texts[7:]:  # the rolling hashes of a document do not depend on its neighbours
        assert got[texts.index(text)].f0 == got[len(texts) - 1 - texts[::-1].index(text)].f0


def test_links_of_wide_fingerprints_are_complete(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(corpus())]
    prints = {r.doc_id: r for r in simhash.fingerprints(spark.createDataFrame(rows, SCHEMA), 5, 256, False).collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 256, 39, 8, False).collect()}
    words = {i: [r[f"f{k}"] % 2**64 for k in range(4)] for i, r in prints.items()}
    assert got == classes(words, lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= 39)


def test_one_of_each_keeps_columns_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "en", "s", 1), (3, text + " end", "en", "s", 1), (3, text + " end", "en", "s", 1), (9, "other words here", "de", None, None), (None, text, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]
    extra = docs.withColumnRenamed("lang", "f0").withColumnRenamed("source", "node")
    assert simhash.one_of_each(extra).count() == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_beside_a_failed_one_are_checked(spark):
    # Stars: copies with one changed word are over 0.8 like their base and below it like each other.
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(6):
        base = words(75)
        texts.append(base)
        for at in rng.choice(np.arange(6, 69), 24, replace=False):
            texts.append([*base[:at], *words(1 + int(at) % 2), *base[at + 1 :]])
        texts += [[*base[:k], *words(15), *base[k:]] for k in (10, 30, 50)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **simhash.SIMILAR).collect()}
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for _ in range(8):
        want = [min(want[j] for j in range(len(texts)) if alike(sets[i], sets[j])) for i in range(len(texts))]
    assert got == dict(enumerate(want))


def test_a_repeated_line_does_not_join_documents(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = words(11)
    texts = [" ".join(line * repeats + words(n)) for n in (60, 100, 200) for repeats in (20, 50) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **simhash.SIMILAR).collect()}
    assert got == {i: i for i in range(len(texts))}


def test_pairs_of_just_the_similarity_and_repeats_are_found(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(30):  # 5 shingles and 4 of them: 0.8
        base = words(9)
        texts += [base, base[:8]]
    for repeats in (10, 30):  # a line once and many times
        base, line = words(200), words(11)
        texts += [line + base, line * repeats + base]
    for _ in range(10):  # one changed block of 1,000 words: 0.8 and just below
        base = words(1004)
        texts += [base, base[:400] + words(107) + base[507:]]
        base = words(1004)
        texts += [base, base[:400] + words(108) + base[508:]]
    line = words(40)  # one line that all of these share
    texts += [line + words(6) for _ in range(30)] + [line + words(14) for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **simhash.SIMILAR).collect()}
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for _ in range(4):
        want = [min(want[j] for j in range(len(texts)) if alike(sets[i], sets[j])) for i in range(len(texts))]
    assert got == dict(enumerate(want)) and len(set(want)) < len(want) - 40

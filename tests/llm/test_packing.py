import random
from collections import defaultdict

from helpers import DATA

from spandrel.llm import packing

SCHEMA = "doc_id long, text string, source string, bin string, size int"


def plain(items, capacity):
    """Best fit by looking at every bin: the smallest sufficient rest, then the bin opened first."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and not (b["s"] & source or b["c"] & cluster)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": 0, "c": 0})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= size
        bins[i]["s"] |= source
        bins[i]["c"] |= cluster
    return out


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    for _ in range(40):
        items = [(rng.randrange(1, 60), 1 << rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.choice([0, 0, 1, 2, 4])) for _ in range(150)]
        assert packing.best_fit(items, 100) == plain(items, 100)


def valid(rows, got, capacity):
    """Every word has one place, nothing overlaps, no bin has a conflict."""
    info = {i: (len((t or "").split()), s, t) for i, t, s in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        if r.bin is not None:
            bins[r.bin].append(r)
    assert set(pieces) == set(info)
    for i, ps in pieces.items():
        assert sum(p.size for p in ps) == info[i][0] and sorted(p.piece for p in ps) == list(range(len(ps)))
        assert all((p.bin is None) == (info[i][0] == 0) for p in ps)
    for rs in bins.values():
        rs.sort(key=lambda r: r.start)
        assert all(a.start + a.size <= b.start for a, b in zip(rs, rs[1:])) and rs[-1].start + rs[-1].size <= capacity
        sources = [info[r.doc_id][1] for r in rs if info[r.doc_id][1] is not None]
        texts = [info[r.doc_id][2] for r in rs]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_packing_is_valid(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)) + f" {i % 150}" * (i % 9 > 0), rng.choice(["hot", "hot", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "b"), (1001, "", None), (1002, "x " * 1000, "hot")]
    docs = spark.createDataFrame([(i, t, s, "b", 1) for i, t, s in rows], SCHEMA)
    for group_rows in (packing.GROUP_ROWS, 64):
        valid(rows, packing.pack_documents(docs, 256, group_rows).collect(), 256)


def test_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = packing.pack_documents(docs).collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    valid([(i, " ".join(x.decode() for x in (t or "").encode().split()), s) for i, t, s in rows], got, packing.CAPACITY)


def test_odd_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b", "s", None, None), (None, "a b", "s", None, None), (1, "a", None, None, None), (1, "a", None, None, None)], SCHEMA)
    got = packing.pack_documents(docs).collect()
    assert len(got) == 4 and len({r.bin for r in got if r.doc_id == 1}) == 2
    assert packing.pack_documents(docs.limit(0)).count() == 0

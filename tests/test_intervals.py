"""Range operators against plane sweeps and brute force, with keys that hold nearly all rows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from spandrel.operators import intervals, ordered

SCHEMA = "k string, id long, start long, end long, extra int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def some(seed, n, keys="aaab", span=400, width=60, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(-span, span)
        out.append((rng.choice(keys), first + i, s, s + rng.choice((0, 1, rng.randrange(width), rng.randrange(4 * width)))))
    return out


def islands(rows, gap):
    out = []
    for k, _, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if out and out[-1][0] == k and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([k, s, e])
    return [tuple(x) for x in out]


def pieces(rows, holes):
    merged = islands(holes, 0)
    out = []
    for k, i, s, e in rows:
        at = s
        mine = [(hs, he) for hk, hs, he in merged if hk == k and hs <= e and he >= s]
        for hs, he in mine:
            if hs > at:
                out.append((k, i, at, hs))
            at = he
        if not mine or at < e:
            out.append((k, i, at, e))
    return sorted(out)


def container(rows, outer):
    out = {}
    for k, i, s, e in rows:
        held = [(oe - os, oi) for ok, oi, os, oe in outer if ok == k and os <= s and oe >= e]
        if held:
            out[i] = min(held)[1]
    return out


@pytest.mark.parametrize("least", [None, 30])
def test_against_brute_force(spark, least):
    a, b = some(1, 300, "abc"), some(2, 250, "aab", first=1000)
    fa, fb = frame(spark, a), frame(spark, b)
    for gap in (0, 1, 5):
        assert sorted(tuple(r) for r in intervals.merge(fa, "k", gap=gap, least=least).select("k", "start", "end").collect()) == islands(a, gap)
    got = intervals.overlapping(fa, fb, "k", least=least)
    assert got.columns == fa.columns
    assert sorted(r.id for r in got.collect()) == sorted(i for k, i, s, e in a if any(k == bk and s <= be and e >= bs for bk, _, bs, be in b))
    assert sorted(tuple(r) for r in intervals.subtract(fa, fb, "k", least=least).select("k", "id", "start", "end").collect()) == pieces(a, b)
    for few in (0, 32, 10**6):
        assert {r.id: r.container_id for r in intervals.smallest_container(fa, fb, "k", least=least, few=few).collect()} == container(a, b)


def test_nulls_ties_and_empty_tables(spark):
    a = [("a", 1, 5, 5), ("a", 2, None, 9), ("a", 3, 4, None), (None, 4, 5, 6), ("a", 5, 5, 5), ("b", 6, 2**50, 2**50 + 7)]
    b = [("a", 10, 0, 8), ("a", 11, 0, 8), ("a", 9, 1, 9), (None, 12, 0, 99), ("a", 13, None, 9), ("b", 14, 2**50 - 1, 2**50 + 7), ("a", 15, 5, 5)]
    for few in (0, 32):
        assert {r.id: r.container_id for r in intervals.smallest_container(frame(spark, a), frame(spark, b), "k", few=few).collect()} == {1: 15, 5: 15, 6: 14}
    assert sorted(r.id for r in intervals.overlapping(frame(spark, a), frame(spark, b), "k").collect()) == [1, 5, 6]
    none = frame(spark, [])
    assert intervals.overlapping(none, frame(spark, b), "k").count() == intervals.smallest_container(none, none, "k").count() == intervals.merge(none, "k").count() == 0
    whole = [r for r in a if None not in r]
    assert sorted(tuple(r) for r in intervals.subtract(frame(spark, whole), none, "k").collect()) == sorted((k, i, s, e) for k, i, s, e in whole)


def test_cells_cover_ranges_exactly(spark):
    rows = [(s, e) for s in range(-9, 10) for e in range(s, 20)] + [(2**45 + 3, 2**45 + 2**20), (0, 2**30 - 1), (7, 7)]
    got = spark.createDataFrame(rows, "s long, e long").select("s", "e", intervals.cells(F.col("s"), F.col("e")).alias("c")).collect()
    for r in got:
        parts = sorted((c.cell << c.level, (c.cell + 1 << c.level) - 1) for c in r.c)
        assert parts[0][0] == r.s and parts[-1][1] == r.e and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(r.c) <= 2 * (r.e - r.s + 1).bit_length()


def test_one_key_of_200_000_ranges_against_a_sweep(spark):
    n = 100_000
    rng = random.Random(5)
    outer = [("a", i, s, s + rng.choice((3, 50, 900, 20_000))) for i, s in enumerate(rng.randrange(10**6) for _ in range(n))]
    inner = [("a", n + i, s, s + rng.choice((0, 2, 40))) for i, s in enumerate(rng.randrange(10**6) for _ in range(n))]
    fo, fi = frame(spark, outer), frame(spark, inner)
    # sweep: starts in order, the furthest end so far
    by_start = sorted((s, e) for _, _, s, e in outer)
    starts, far = [s for s, _ in by_start], []
    for _, e in by_start:
        far.append(max(e, far[-1] if far else e))
    hit = {i for _, i, s, e in inner if (p := bisect.bisect_right(starts, e)) and far[p - 1] >= s}
    assert {r.id for r in intervals.overlapping(fi, fo, "k", least=20_000).select("id").collect()} == hit
    # sweep by width: of the four widths the smallest that holds it wins, and of those the smallest id
    best = {}
    for width in (3, 50, 900, 20_000):
        own = sorted((s, i) for _, i, s, e in outer if e - s == width)
        at = [s for s, _ in own]
        for _, i, s, e in inner:
            if i not in best:
                lo, hi = bisect.bisect_left(at, e - width), bisect.bisect_right(at, s)
                if lo < hi:
                    best[i] = min(j for _, j in own[lo:hi])
    assert {r.id: r.container_id for r in intervals.smallest_container(fi, fo, "k", least=20_000).collect()} == best


def test_running_values_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "cold").otherwise("hot").alias("k"), F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    parts = ordered.cut(rows, ["k"], ["id"], 400)
    assert parts.where("_part > 0").groupBy("_part").count().agg(F.max("count")).first()[0] < 2000
    got = ordered.scan(parts, ["k"], ["id"], total=("sum", F.col("v")), top=("max", F.col("v")), low=("min", F.struct("v", "id")))
    before = ordered.scan(parts, ["k"], ["id"], exclusive=True, total=("sum", F.col("v")))
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        t, m, lo = seen.get(r.k, (0, 0, (999, 0)))
        seen[r.k] = t + r.v, max(m, r.v), min(lo, (r.v, r.id))
        want[r.id] = (*seen[r.k], t if t or r.k in want else None)
        want[r.k] = True
    assert all(want[r.id][:3] == (r.total, r.top, tuple(r.low)) for r in got.collect())
    assert all((r.total or 0) == (want[r.id][3] or 0) for r in before.collect())

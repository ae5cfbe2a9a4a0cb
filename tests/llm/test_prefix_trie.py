import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import DATA, same, sql_rows

from spandrel.llm import prefix_trie as pt
from spandrel.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, None) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children.get(k)
            saved[k[:d]] += (len(v) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted(((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children.get(k, 0), leaves[k], saved[k], sha(ends.get(k, []))) for k, v in members.items()), key=str)


def check(spark, rows, **more):
    assert sorted((tuple(r) for r in pt.trie(frame(spark, rows), **more).collect()), key=str) == brute(rows)


def some(seed, n):
    """Conversations that share beginnings, some of them whole, with gaps in their ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 4 * n), n):
        for turn in range(rng.choice((1, 2, 3, 5, 9))):
            rows.append((c, turn, rng.choice(["user", "bot"]) if turn > 2 else "user", f"é{rng.choice('ab' if turn < 3 else 'abcdef')}" * (turn + 1)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, some(seed, 150))


def test_long_conversations_and_hot_nodes_in_small_segments(spark, monkeypatch):
    monkeypatch.setattr(pt, "SEGMENT", 4)
    monkeypatch.setattr(pt, "BLOCK", 8)
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(40 + c)] + [(c, t, "user", "same") for c in range(200, 300) for t in range(2)] + [(400 + c, 0, "user", "t0") for c in range(30)]
    random.Random(3).shuffle(rows)
    check(spark, rows, long=20)


def test_nulls_repeats_ties_and_odd_texts(spark):
    rows = [(None, 0, "user", "nobody"), (0, None, None, None), (0, None, "", ""), (0, 1, "user", "b"), (0, 1, "bot", "b"), (0, 1, "bot", "b"), (7, -3, "a", "bc"), (7, 2, "ab", "c"), (107, 1, "x", "y" * 200_000), (207, 1, "x", "y" * 200_000), (307, 5, "é", "İ😀"), (308, 5, "é", "İ😀"), (-5, 1, "n", "m"), (-105, 1, "n", "m")]
    check(spark, rows)


def test_only_turnless_conversations(spark):
    ids = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 > 0]  # nothing is left of one turn, and nobody opens their hundred
    check(spark, [(c, 1, "u", "t") for c in ids])


def test_a_light_path_at_every_level(spark):
    rows = []
    for c in range(64):  # a full binary tree below a common opening
        rows += [(1000 + c * 100, t, "u", "ab"[c >> t & 1] if t < 6 else "end") for t in range(7)]
    check(spark, rows)


def test_query_against_sql(spark):
    same(queries.op12_conversation_prefix_trie(spark, str(DATA / "sf0.001")), sql_rows(pt.SQL))


def test_empty_table(spark):
    assert pt.trie(frame(spark, [])).count() == 0

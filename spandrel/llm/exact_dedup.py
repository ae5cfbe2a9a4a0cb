"""Exact dedup: a minimal perfect hash over the distinct digests of earlier rows, looked up by the distinct digests of new ones.

The SHA-256 digests of the earlier rows are dealt into shards of about ``KEYS`` by a hash. In each shard a cascade of bit fields (a key whose bit is its own at a
level ends there, the others go on to the next) gives every digest a slot of its own, the rank of its bit; no slot stays empty. Slots hold the full digest,
the winner's locator (doc_id and row) and the number of rows. The index is a table of one row a shard.

New rows are first grouped by digest with partial aggregation, so that copies meet before they are shuffled. A digest that the hash leads to a slot is compared with the
slot's 32 bytes: if equal, it joins that group, and the winner is chosen anew; if not, or if no bit is set, it is no member and stays a group of its own.
Rows get their group's winner by a join to which only groups of two or more rows go; groups with over a thousandth of all rows (a thousand groups at most) are broadcast.

Defined results: a null text is an empty one; a null doc_id is smaller than all others; of rows with equal text and doc_id one stays, so each group keeps exactly one
row; very long texts are hashed whole; other columns are not read, whatever their names; an empty table gives an empty result, an empty history an index of no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.lineage import materialize

U64 = np.uint64
#: Digests of a shard, bits of a level for each key that reaches it, and levels; keys that share their 64 bits beyond the last one are listed.
KEYS, ROOM, LEVELS = 2048, 2, 32
#: Groups of over one in so many rows are broadcast, and their least size.
HOT_SHARE, HOT_ROWS = 1000, 1000
INDEX = "shard long, sizes array<int>, bits binary, digests binary, ids array<long>, rows array<long>, counts array<long>"
FOUND = "digest binary, keep_id long, keep_row long, group_size long, historical boolean"


def digests_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column of 32 bytes each, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _key(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 8:16]).view("<u8").ravel().astype(U64)


def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tx.mix(key + U64(level + 1) * U64(tx.BASE & (2**58 - 1))) % U64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits, and the order in which the distinct ``digests`` fill the slots."""
    key, left = _key(digests), np.arange(len(digests))
    sizes, bits, order = [], [], []
    while len(left) and len(sizes) < LEVELS:
        sizes.append(max(8, ROOM * len(left)))
        place = _place(key[left], len(sizes) - 1, sizes[-1])
        alone = np.bincount(place, minlength=sizes[-1]) == 1
        own = alone[place]
        order.append(left[own][np.argsort(place[own])])
        bits.append(alone)
        left = left[~own]
    return sizes, np.concatenate([*bits, np.empty(0, bool)]), np.concatenate([*order, left])


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot of each of ``digests``, -1 where the slot it is led to holds other bytes or there is none. held: the digests in the slots."""
    key, out, left, base = _key(digests), np.full(len(digests), -1), np.arange(len(digests)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        place = base + _place(key[left], level, size)
        hit = bits[place]
        out[left[hit]] = rank[place[hit]]
        left, base = left[~hit], base + size
    listed = {held[k].tobytes(): k for k in range(int(bits.sum()), len(held))}
    for i in left if listed else ():
        out[i] = listed.get(digests[i].tobytes(), -1)
    led = np.flatnonzero(out >= 0)
    out[led[(held[out[led]] != digests[led]).any(axis=1)]] = -1
    return out


def groups(rows: DataFrame) -> DataFrame:
    """shard, digest, keep_id, keep_row and group_size of each digest in ``rows``."""
    return rows.groupBy("shard", "digest").agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"), F.count("*").alias("group_size"))


def index(known: DataFrame) -> DataFrame:
    """One row a shard: the hash of its digests and what their slots hold."""

    def run(part: pa.Table) -> pa.Table:
        digests = digests_of(part.column("digest"))
        sizes, bits, order = build(digests)
        held = [part.column(c).take(pa.array(order)).to_pylist() for c in ("keep_id", "keep_row", "group_size")]
        values = [part.column("shard")[0].as_py(), sizes, np.packbits(bits).tobytes(), digests[order].tobytes(), *held]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "sizes", "bits", "digests", "ids", "rows", "counts"])

    types = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return known.groupBy("shard").applyInArrow(run, INDEX)


def _merged() -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["digest", "keep_id", "keep_row", "group_size", "historical"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(new: pa.Table, known: pa.Table) -> pa.Table:
        digests, ids, rows, counts = (new.column(c).to_pylist() for c in names[:4])
        out = [(d, i, r, n, False) for d, i, r, n in zip(digests, ids, rows, counts, strict=True)]
        if known.num_rows:
            shard = known.to_pylist()[0]
            held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
            bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8))[: sum(shard["sizes"])].astype(bool)
            slot = slots(digests_of(new.column("digest")), shard["sizes"], bits, held).tolist()
            won = list(zip(shard["ids"], shard["rows"], shard["counts"], strict=True))
            for k, s in enumerate(slot):
                if s >= 0:
                    mine, theirs = out[k], won[s]
                    best = max((mine[1] is not None, mine[1] or 0, mine[2]), (theirs[0] is not None, theirs[0] or 0, theirs[1]))
                    won[s] = (best[1] if best[0] else None, best[2], mine[3] + theirs[2])
            out = [x for x, s in zip(out, slot, strict=True) if s < 0] + [(held[k].tobytes(), *w, True) for k, w in enumerate(won)]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    return run


def looked_up(new: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each digest of either side, as in FOUND: members are merged with their slot, all others form groups of their own."""
    return new.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_merged(), FOUND)


def dedup(docs: DataFrame, history: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and historical (whether the text is in the index) of every row; rows for which ``history`` holds make up the index, the others are looked up."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"))
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-total // KEYS)))))
    known = materialize(index(groups(sharded.where("old"))))
    found = materialize(looked_up(groups(sharded.where("not old")), known))
    several, limit = found.where("group_size > 1"), max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(several.where(F.col("group_size") > limit))
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(several.where(F.col("group_size") <= limit), "digest", "left")
    joined = rows.join(hot, "digest").unionByName(cold)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("historical", F.col("old")).alias("historical"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

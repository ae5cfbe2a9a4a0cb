"""Best-fit packing of documents into bins of fixed size, under conflicts.

A bin never holds two documents of one source, nor two of one duplicate cluster. Open bins are kept in order of what is left
in them, with a bitmap of their sources and one of their clusters; the search starts at the smallest sufficient rest and
goes on to its successors until a bin has neither conflict. Items come in falling size.

Documents are dealt to packing groups of bounded size by a hash of their id, so that no group grows with the table or with a
hot source; bins are not shared between groups. Only ids, sizes, sources and clusters are shuffled, never texts.

Defined results: documents longer than a bin are cut into pieces, full ones have a bin of their own; a document without words
(or a null text) gets one row with a null bin; a null source conflicts with nothing; equal doc_ids are separate documents,
which conflict as copies if their texts are equal; ties in size go to the smaller doc_id; very long texts are
counted whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ROWS = 4096


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """For each item (size, source bitmap, cluster bitmap), in the given order, its bin and the offset in it."""
    open_bins: list[tuple[int, int]] = []  # (what is left, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        i = bisect_left(open_bins, (size, -1))
        while i < len(open_bins) and (sources[open_bins[i][1]] & source or clusters[open_bins[i][1]] & cluster):
            i += 1
        if i < len(open_bins):
            left, b = open_bins.pop(i)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((b, capacity - left))
        sources[b] |= source
        clusters[b] |= cluster
        if left > size:
            insort(open_bins, (left - size, b))
    return out


def pack(docs: DataFrame, size: Column, cluster: Column, source: Column, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, size, bin and start (its offset in the bin) of every piece of every document."""
    groups = max(1, -(-docs.count() // group_rows))
    id_type = dict(docs.dtypes)["doc_id"]
    items = docs.select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("size"), cluster.cast("long").alias("cluster"), source.cast("string").alias("source"))
    items = items.withColumn("pack_group", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        rows, group = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "size", "cluster", "source")), strict=True)), table.column("pack_group")[0].as_py()
        bit = {s: 1 << i for i, s in enumerate(sorted({r[3] for r in rows if r[3] is not None}))}
        seen: dict[int, int] = {}
        for _, _, c, _ in rows:
            seen[c] = seen.get(c, 0) + 1
        shared = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
        pieces = []
        for doc, n, c, s in rows:
            for k in range(-(-n // capacity)):
                pieces.append((min(capacity, n - k * capacity), doc, k, bit.get(s, 0), shared.get(c, 0)))
        pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1], p[2]))
        placed = best_fit([(p[0], p[3], p[4]) for p in pieces], capacity)
        out = [(p[1], p[2], p[0], (group << 32) + b, start) for p, (b, start) in zip(pieces, placed, strict=True)]
        out += [(doc, 0, 0, None, None) for doc, n, _, _ in rows if n == 0]
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(columns[0], table.schema.field("doc_id").type), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["doc_id", "piece", "size", "bin", "start"])

    return items.groupBy("pack_group").applyInArrow(run, f"doc_id {id_type}, piece long, size long, bin long, start long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Documents by their words; copies of a text are a cluster."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return pack(docs, words, F.xxhash64("text"), F.col("source"), capacity, group_rows)

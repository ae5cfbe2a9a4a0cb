"""Sharding by sampled splitters into shards of near-equal bytes.

Records are ordered by a key: a hash of the text above one of the row, so equal texts are neighbours and yet can be parted. Keys are drawn with probability in
proportion to size; their quantiles are splitters that cut the order into ranges. Shards are runs of whole ranges: a shard ends at the splitter that is nearest to
its share of the bytes. A range that holds such an end and is larger than ``TOLERANCE`` of a shard is overfull, and so is one with more than twice the rows it should have (many small records, such as
null texts, have few bytes; the row's bits of the key part them); it gets splitters from a draw of its own, all of them in one job a round, until none is. So shards differ from the mean by at most ``TOLERANCE`` of it or by one record, whichever is more.

Only ids, sizes and keys are sorted and shuffled. The driver sees the drawn keys and one row a range.

Defined results: a null text has size 1 and checksum 0; repeated rows are records of their own and take slots in any order; a null doc_id is a record like any other; very long texts count
by their bytes, and one that is larger than a shard fills its shard alone or with few others; an empty table gives an empty result; with fewer records than shards some
shards stay empty; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize

SHARDS = 8
RANGE_ROWS, LEAST_RANGES, DRAWS = 1_000_000, 256, 32
#: Share of a shard's bytes by which it may miss its end; rounds that may be needed at most.
TOLERANCE, ROUNDS = 1 / 500, 40
#: Bits of the key that come from the row, not the text.
ROW_BITS = 24


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every document."""
    text = F.coalesce("text", F.lit(""))
    row = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - ROW_BITS)
    key = F.shiftleft(F.shiftright(F.xxhash64(text), ROW_BITS), ROW_BITS).bitwiseOR(row)
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"))


def ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with column part: how many splitters lie below the record's key."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(shared.value, batch.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part int")


def drawn(rows: DataFrame, times: DataFrame, seed: int) -> list[tuple[int, int, int]]:
    """part, key and how often of draws from ``rows`` (part, key, size): for each part in ``times`` about draws, each record in proportion to its size."""
    expected = F.col("size") * F.col("draws") / F.col("bytes")
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(F.broadcast(times), "part").select("part", "key", F.floor(expected + chance).cast("int").alias("n")).where("n > 0")
    return [tuple(r) for r in picked.collect()]


def quantiles(keys: list[tuple[int, int]], pieces: int) -> list[int]:
    """Up to pieces - 1 splitters at equal steps of the drawn weight (key, how often)."""
    keys = sorted(keys)
    weight = np.cumsum([n for _, n in keys])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces) if keys else []
    return [keys[i][0] for i in at]


def sizes(rows: DataFrame, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and rows of each range, and whether it has more than one key."""
    out = np.zeros((3, len(splitters) + 1), np.int64)
    for p, *found in ranged(rows.select("key", "size"), splitters).groupBy("part").agg(F.sum("size"), F.count("*"), (F.min("key") < F.max("key")).cast("int")).collect():
        out[:, p] = found
    return out[0], out[1], out[2] > 0


def split(rows: DataFrame, n: int, total: int, shards: int, ranges: int, tolerance: float, range_rows: int = RANGE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters, the first range of each shard, and the rows of each range (``n`` in all)."""
    spark, splitters, seed = rows.sparkSession, np.empty(0, np.int64), 0
    wanted = {0: (ranges, total)}
    while True:
        seed += 1
        if seed > ROUNDS:
            raise RuntimeError(f"ranges are still overfull after {ROUNDS} rounds")
        times = spark.createDataFrame([(p, float(DRAWS * pieces), b) for p, (pieces, b) in wanted.items()], "part int, draws double, bytes long")
        found: dict[int, list[tuple[int, int]]] = {}
        for p, key, k in drawn(ranged(rows.select("key", "size"), splitters), times, seed):
            found.setdefault(p, []).append((key, k))
        new = {s for p, keys in found.items() for s in quantiles(keys, wanted[p][0])}
        # On later rounds a drawn record becomes a range of its own, which parts a very large one from its neighbours.
        new |= {s - 1 for s in new} if seed > 1 else set()
        splitters = np.array(sorted({*splitters.tolist(), *new} - {-(2**63) - 1}), np.int64)
        size, count, many = sizes(rows, splitters)
        ends = np.cumsum(size)
        targets = total * np.arange(1, shards) / shards
        at = np.minimum(np.searchsorted(ends, targets), len(size) - 1)
        # The end of a shard is the nearer end of the range that holds its share.
        begin = ends[at] - size[at]
        first = np.where(targets - begin < ends[at] - targets, at, at + 1)
        miss = np.minimum(targets - begin, ends[at] - targets)
        overfull = np.unique(at[(miss > tolerance * total / shards) & many[at]])
        crowded = np.flatnonzero((count > 2 * range_rows) & many)
        if not len(overfull) and not len(crowded):
            return splitters, np.concatenate([[0], np.maximum.accumulate(first)]), count
        wanted = {int(p): (int(min(64, count[p], n)), int(size[p])) for p in overfull}
        for p in crowded.tolist():
            wanted[p] = (max(wanted.get(p, (0,))[0], int(min(4096, -(-count[p] // range_rows) + 1))), int(size[p]))


def shard(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS, least: int = LEAST_RANGES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    rows = materialize(records(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    result = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*result)
    splitters, first, count = split(rows, n, total, shards, max(least, -(-n // range_rows)), tolerance, range_rows)
    before = np.cumsum(count) - count
    of_range = np.searchsorted(first, np.arange(len(count)), "right") - 1
    start = [(p, int(of_range[p]), int(before[p] - before[min(first[of_range[p]], len(count) - 1)])) for p in range(len(count))]
    offsets = rows.sparkSession.createDataFrame(start, "part int, shard int, before long")
    inside = Window.partitionBy("part").orderBy("key", "doc_id")
    placed = ranged(rows, splitters).withColumn("row", F.row_number().over(inside)).join(F.broadcast(offsets), "part")
    return placed.withColumn("slot", F.col("before") + F.col("row") - 1).select(*result)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, pieces: int = 64) -> None:
    """Write ``docs`` (unique doc_ids) under ``path``, a folder a shard, rows in slot order within and over its files, which up to ``pieces`` tasks a shard write."""
    placed = shard(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartitionByRange(shards * pieces, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Ranked lexical search over an inverted index of shards; each shard is searched document at a time.

Index: a task cuts its documents into shards of about ``SHARD_BYTES`` of text, one row each, so no posting is shuffled. In a shard documents stand in the order of
their ids; a term's postings are gaps of places and term frequencies as variable-length bytes. ``index(docs)`` gives the table, which holds every term of every document and can be written and searched again.

Search: document frequencies of the terms asked for are summed over the shards, then every task walks its shards. For an item, a heap of cursors merges the terms'
postings by place; the ten best so far are kept in a heap whose root has the lowest score and, of equal scores, the largest doc_id. Once it is full, terms that could not lift a
document above the root together do not drive the merge any more and are only looked up (an exact bound, from the highest part that a term has in the shard). The best of each task are merged by one window.
Items go in blocks of about ``BLOCK_TERMS`` terms, which bounds what is broadcast.

A term is a maximal run of bytes other than the separators, only A-Z lower-cased. Score: weights floor(1000 ln((2N + 2) / (2 df + 1))) and term frequencies
saturated by document length, in 64-bit integers (see ``parts``).

Defined results: a null or empty text has no terms and counts in no statistic; a null doc_id can be found and comes after all others of its score; rows of equal doc_id are
documents of their own, and so are items of equal item_id; an item with a null text, or that no document scores for, gives no rows; very long texts make a shard of their own; other columns are not
read, whatever their names; empty tables give empty results. Inside a shard terms are told apart by 64-bit hashes, terms asked for are compared by their bytes.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.lineage import materialize, small_batches

U64 = np.uint64
TOP, SHARD_BYTES, BLOCK_TERMS = 10, 8 << 20, 200_000
#: Bytes of separators become a space, those of A-Z their lower case.
FOLD = np.arange(256, dtype=np.uint8)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    FOLD[_lo : _hi + 1] = 0x20
FOLD[65:91] += 32
INDEX = "doc_ids array<long>, lengths binary, n_docs long, n_terms long, hashes binary, df binary, spelled binary, spelled_ends binary, postings binary, postings_ends binary"
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first; the top bit is set on all bytes but a value's last. Also where each value ends."""
    values = values.astype(U64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= U64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[ends[at] - size[at] + k] = ((values[at] >> U64(7 * k)) & U64(127)) | np.where(size[at] > k + 1, U64(128), U64(0))
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128) + 1
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.append(0, ends[:-1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw & 127).astype(U64) << (place * 7).astype(U64), starts).astype(np.int64)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tx.Words:
    return tx.words_of(FOLD[data], offsets)


def spelling(words: tx.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words ``at``, one after the other, and where each ends."""
    size = (words.end - words.start)[at]
    ends = np.cumsum(size)
    return words.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.start[at] - ends + size, size)], ends


def shard(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> list:
    """The columns of INDEX for documents in the order of their ids."""
    words = terms_of(data, offsets)
    h, doc = words.hashes(), words.doc
    order = np.argsort(h, kind="stable")  # places stay in order inside a term
    h, doc = h[order], doc[order]
    first = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(first)
    tf, h, doc = np.diff(at, append=len(order)), h[at], doc[at]
    head = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    gaps = np.where(head, doc, np.diff(doc, prepend=0))
    raw, ends = packed(np.column_stack([gaps, tf]).ravel())
    heads = np.flatnonzero(head)
    df = np.diff(heads, append=len(h))
    spelled, spelled_ends = spelling(words, order[at[heads]])
    counts = words.counts
    u32 = lambda a: a.astype(np.uint32).tobytes()
    return [ids.to_pylist(), packed(counts)[0].tobytes(), int((counts > 0).sum()), int(counts.sum()), h[heads].tobytes(), u32(df), spelled.tobytes(), u32(spelled_ends), raw.tobytes(), u32(ends[2 * (heads + df) - 1])]


def _index(most: int):
    types = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table.column("doc_id"), null_placement="at_end")).combine_chunks()
        for lo, hi, data, offsets in tx.slices(table.column("text"), most):
            row = shard(table.column("doc_id").chunk(0)[lo:hi], data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from made(held)
                held, size = [], 0
        if size or any(b.num_rows for b in held):
            yield from made(held)

    return run


def index(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of documents, as in INDEX."""
    small_batches(docs.sparkSession, 10_000)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_index(most), INDEX)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Shards are large: one at a time becomes Python values."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Shard:
    """One row of the index, and the terms asked for that it holds."""

    def __init__(self, row: dict, hashes: np.ndarray, spelled: list[bytes]):
        self.row, of = row, lambda c, t: np.frombuffer(row[c], t)
        own, ends, words = of("hashes", U64), of("spelled_ends", np.uint32), row["spelled"]
        place = np.searchsorted(own, hashes)
        near = np.flatnonzero(place < len(own))
        near = near[own[place[near]] == hashes[near]]
        self.found = [(int(k), int(p)) for k, p in zip(near, place[near], strict=True) if words[int(ends[p - 1]) if p else 0 : int(ends[p])] == spelled[k]]
        self.df = of("df", np.uint32)

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents that hold a term, and its frequency in each."""
        ends = np.frombuffer(self.row["postings_ends"], np.uint32)
        raw = np.frombuffer(self.row["postings"], np.uint8)[int(ends[place - 1]) if place else 0 : int(ends[place])]
        both = unpacked(raw).reshape(-1, 2)
        return np.cumsum(both[:, 0]), both[:, 1]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def parts(w: int, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to the score of each document that holds it."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * length * n) // total)))


def best_first(score: int, doc_id: int | None) -> tuple[int, bool, int]:
    """Greater for higher scores, then for smaller ids; null comes last."""
    return score, doc_id is not None, -(doc_id or 0)


def merged(lists: list[tuple[int, list[int], list[int]]], ids: list, best: list, top: int) -> None:
    """Walk the postings (highest part, places, parts) of one item's terms, the lowest bound first, and put the best documents into the heap ``best``."""
    places, added = [x[1] for x in lists], [x[2] for x in lists]
    reach = np.cumsum([x[0] for x in lists]).tolist()
    k, at, free = len(lists), [0] * len(lists), 0
    least = best[0][0] if len(best) == top else 0
    while free < k and reach[free] < least:
        free += 1
    cursors = [(places[i][0], i, 0) for i in range(free, k)]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, i, p = cursors[0]
            score += added[i][p]
            if p + 1 < len(places[i]):
                heapq.heapreplace(cursors, (places[i][p + 1], i, p + 1))
            else:
                heapq.heappop(cursors)
        for j in range(free - 1, -1, -1):
            if score + reach[j] < least:
                score = 0
                break
            at[j] = bisect_left(places[j], doc, at[j])
            if at[j] < len(places[j]) and places[j][at[j]] == doc:
                score += added[j][at[j]]
        if score <= 0 or score < least:
            continue
        entry = best_first(score, ids[doc])
        if len(best) < top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == top and best[0][0] > least:
            least, before = best[0][0], free
            while free < k and reach[free] < least:
                free += 1
            if free > before:
                cursors = [c for c in cursors if c[1] >= free]
                heapq.heapify(cursors)


def _asked(items: DataFrame) -> DataFrame:
    """item_id, item (its own number) and its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                words = terms_of(data, offsets)
                raw, start, end, first = words.data.tobytes(), words.start, words.end, words.first
                terms = [sorted({raw[start[i] : end[i]] for i in range(first[d], first[d + 1])}) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id")[lo:hi], batch.column("item")[lo:hi], pa.array(terms, pa.list_(pa.binary()))], ["item_id", "item", "terms"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "item_id long, item long, terms array<binary>")


def _frequencies(table: DataFrame, hashes, spelled) -> dict[int, int]:
    """In how many documents each term asked for occurs."""
    shared = table.sparkSession.sparkContext.broadcast((hashes, spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value[0]), np.int64)
        for batch in batches:
            for row in rows_of(batch):
                own = Shard(row, *shared.value)
                for k, p in own.found:
                    total[k] += own.df[p]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    found = table.select("hashes", "df", "spelled", "spelled_ends").mapInArrow(run, "term long, df long")
    return {r.term: r.df for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _block(table: DataFrame, asked: list, n: int, total: int, top: int) -> DataFrame:
    """item, item_id, doc_id and score of the best documents of each task for the items ``asked``."""
    spelled = sorted({t for r in asked for t in r.terms})
    ends = np.cumsum([0, *map(len, spelled)])
    raw = np.frombuffer(b"".join(spelled), np.uint8)
    hashes = tx.Words(raw, ends[:-1], ends[1:], np.array([0, len(spelled)])).hashes() if spelled else np.empty(0, U64)
    number = {t: k for k, t in enumerate(spelled)}
    df = _frequencies(table, hashes, spelled)
    weights = {k: weight(n, d) for k, d in df.items()}
    items = [(r.item, r.item_id, [k for t in r.terms if (k := number[t]) in weights]) for r in asked]
    shared = table.sparkSession.sparkContext.broadcast((hashes, spelled, weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spelled, weights, items = shared.value
        best = [[] for _ in items]
        for batch in batches:
            for row in rows_of(batch):
                own, lists = Shard(row, hashes, spelled), {}
                lengths = unpacked(np.frombuffer(row["lengths"], np.uint8))
                for k, p in own.found:
                    places, tf = own.postings(p)
                    added = parts(weights[k], tf, lengths[places], n, total)
                    lists[k] = (int(added.max()), places.tolist(), added.tolist())
                for (_, _, terms), heap in zip(items, best, strict=True):
                    if held := sorted((lists[k] for k in terms if k in lists), key=lambda x: x[0]):
                        merged(held, row["doc_ids"], heap, top)
        out = [(item, item_id, -entry[2] if entry[1] else None, entry[0]) for (item, item_id, _), heap in zip(items, best, strict=True) for entry in heap]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return materialize(table.mapInArrow(run, "item long, item_id long, doc_id long, score long"))


def search(table: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of the index ``table`` for each of ``items`` (item_id, text)."""
    small_batches(table.sparkSession)
    n, total = table.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = materialize(_asked(items).where(F.size("terms") > 0))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    found = table.sparkSession.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for k in range(blocks if n else 0):
        found = found.unionAll(_block(table, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect(), n, total, top))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
tf AS MATERIALIZED (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) GROUP BY row, t),
q AS (SELECT DISTINCT item, item_id, t FROM (SELECT item, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS item, item_id, {WORDS_SQL} AS w FROM benchmark))),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t), s),
scores AS (SELECT item, item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n) // total)))) AS BIGINT) AS score
  FROM q JOIN weights USING (t) JOIN tf USING (t) JOIN d USING (row), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

"""Hashes of word n-grams and their counts over a corpus, as tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import text as tx

U64 = np.uint64
#: Different n-grams that a task adds up before it sends them on.
HELD = 2_000_000


def ngrams(words: tx.Words, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each k up to ``order``: k, the 64-bit hashes of the k-grams, of their first and of their last k - 1 words (0 for words), and their documents.

    A k-gram's hash mixes those of its first and last k - 1 words, so it is a function of the words and of k.
    """
    h, doc = words.hashes(), words.doc
    yield 1, h, np.zeros(len(h), U64), np.zeros(len(h), U64), doc
    for k in range(2, order + 1):
        inside = doc[1:] == doc[:-1]
        context, suffix, doc = h[:-1][inside], h[1:][inside], doc[1:][inside]
        h = tx.mix(tx.mix(context + U64(k)) * U64(tx.BASE) + suffix)
        yield k, h, context, suffix, doc


def merged(found: list[np.ndarray]) -> np.ndarray:
    """Rows (order, gram, context, suffix, n) with equal grams of an order added up."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    at = np.flatnonzero(new)
    out = rows[at]
    out[:, 4] = np.add.reduceat(rows[:, 4], at) if len(at) else 0
    return out


def counts(docs: DataFrame, order: int) -> DataFrame:
    """order, gram, context, suffix and n of every n-gram of ``docs`` (text) up to ``order``; each task adds up its own first."""

    def rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(table), 65_536):
            part = table[i : i + 65_536].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, c])) for c in range(1, 5))], ["order", "gram", "context", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        new = 0
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column("text")):
                for k, gram, context, suffix, _ in ngrams(tx.words_of(data, offsets), order):
                    held.append(merged([np.column_stack([np.full(len(gram), k, U64), gram, context, suffix, np.ones(len(gram), U64)])]))
                    new += len(held[-1])
                if new > HELD:
                    held = [merged(held)]
                    if len(held[0]) > HELD:  # enough for one task
                        yield from rows(held.pop())
                    new = sum(map(len, held))
        if held:
            yield from rows(merged(held))

    found = docs.select("text").mapInArrow(run, "order int, gram long, context long, suffix long, n long")
    return found.groupBy("order", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of ``table`` whose n is at least a bound that at most ``most`` rows reach. Counts by size decide, so no task sorts or gathers."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((s, c) for s, c in table.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, total = None, 0
    for s, c in sizes:
        total += c
        if total > most:
            break
        least = s
    return table.where(step >= least) if least is not None else table.limit(0)


def known(table: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``gram`` are in ``table`` (in order), and the places of those."""
    if not len(table):
        return np.zeros(len(gram), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
    hit = table[at] == gram
    return hit, at[hit]


def plain_counts(docs: DataFrame, orders: range, among: np.ndarray | None = None) -> DataFrame:
    """gram and n of the n-grams of ``orders``, or of those ``among`` (hashes in order) only; each task adds up its own first."""
    shared = docs.sparkSession.sparkContext.broadcast(among)

    def rows(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(gram), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 65_536].view(np.int64)), pa.array(n[i : i + 65_536])], ["gram", "n"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, inverse = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return gram, np.bincount(inverse, np.concatenate([n for _, n in held]), len(gram)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        new = 0
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column("text")):
                for k, gram, *_ in ngrams(tx.words_of(data, offsets), max(orders, default=1)):
                    if k in orders:
                        gram = gram if shared.value is None else gram[known(shared.value, gram)[0]]
                        gram, n = np.unique(gram, return_counts=True)
                        held.append((gram, n.astype(np.int64)))
                        new += len(gram)
                if new > HELD:
                    held = [added(held)]
                    if len(held[0][0]) > HELD:  # enough for one task
                        yield from rows(*held.pop())
                    new = sum(len(g) for g, _ in held)
        if held:
            yield from rows(*added(held))

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))

"""Substring dedup: every window of ``WINDOW`` words gets a Rabin-Karp hash; windows that also start in a document with a smaller doc_id go.

A window that occurs in two documents has its minimiser (the least hash of the ``PART``-word runs inside it) in both. So minimisers, a
twentieth as many as windows, are counted first; only windows whose minimiser occurs in two documents can repeat, and only these are
counted by their own hash. No repeated window is lost. Words under removed windows merge into maximal intervals.

Counts are pre-aggregated before each shuffle and hot windows are joined as skewed partitions; a document's text is shuffled once, to
meet its minimisers and later its removed windows (both joins share the exchange).

Defined results: a null text has no words; a text shorter than a window stays whole; copies of a window inside one document, or in rows of
equal doc_id, do not remove each other; a null doc_id is never smaller and loses nothing; very long texts and words are read whole; other columns are not read, whatever
their names; an empty table gives an empty result. Windows of different documents are compared by 96 bits: a rolling hash of 64 and 32 of a second one, over word hashes that are no
polynomials. At 10**12 different windows the chance that any two are mistaken for each other is below 1 in 100,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.lineage import materialize, small_batches

U64 = np.uint64
WINDOW, PART = 50, 8


def windows(words: tx.Words, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check (32 bits of a hash of its own) and minimiser of each window inside one document, and the index of its first word."""
    h = words.hashes()
    if len(h) < window:
        return np.empty(0, U64), np.empty(0, np.int32), np.empty(0, U64), np.empty(0, np.int64)
    grams, at = words.windows(h, window)
    check = (tx.rolling(tx.mix(h ^ U64(0x9FB21C651E98DF25)), window)[at] >> U64(32)).astype(np.uint32).view(np.int32)
    return grams, check, tx.sliding_min(tx.rolling(h, part), window - part + 1)[at], at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_parent_indices().to_numpy() if len(column) else np.empty(0, np.int64), column.flatten().to_numpy().view(U64) if len(column) else np.empty(0, U64)


def _pair(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return tx.mix(value + tx.mix(row.astype(U64) + U64(1)))


def _anchors(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, data, offsets in tx.slices(batch.column("text")):
                words = tx.words_of(data, offsets)
                _, _, least, at = windows(words, window, part)
                doc = words.doc[at]
                new = np.flatnonzero((np.diff(least, prepend=least[:1] + U64(1)) != 0) | (np.diff(doc, prepend=-1) != 0)) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[lo + doc[new]])], ["anchor", "doc_id"])

    return run


def _flagged(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_struct_array(batch.to_struct_array().filter(batch.column("anchors").is_valid()))
            ids, (row, anchor) = batch.column("doc_id").to_numpy(), _lists(batch.column("anchors"))
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                words = tx.words_of(data, offsets)
                grams, check, least, at = windows(words, window, part)
                doc, own = words.doc[at], (row >= lo) & (row < hi)
                flagged = np.isin(_pair(doc, least), _pair(row[own] - lo, anchor[own]))
                yield pa.RecordBatch.from_arrays([pa.array(grams[flagged].view(np.int64)), pa.array(check[flagged]), pa.array(ids[lo + doc[flagged]])], ["gram", "check", "doc_id"])

    return run


def _cut(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gram = _lists(batch.column("grams"))
            n_words, n_removed, digests, texts = [], [], [], []
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                words = tx.words_of(data, offsets)
                own = (row >= lo) & (row < hi)
                covered = np.zeros(len(words) + 1, np.int64)
                if own.any():
                    grams, _, _, at = windows(words, window, part)
                    gone = at[np.isin(_pair(words.doc[at], grams), _pair(row[own] - lo, gram[own]))]
                    np.add.at(covered, gone, 1)
                    np.add.at(covered, gone + window, -1)
                keep = np.cumsum(covered)[:-1] == 0
                raw, start, end = data.tobytes(), words.start.tolist(), words.end.tolist()
                kept = np.concatenate([[0], np.cumsum(keep)])
                left = np.flatnonzero(keep).tolist()
                for d in range(hi - lo):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    text = b" ".join([raw[start[i] : end[i]] for i in left[kept[a] : kept[b]]])
                    n_words.append(b - a)
                    n_removed.append(b - a - int(kept[b] - kept[a]))
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode())
            arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space) of every document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = materialize(docs.where("doc_id is not null").mapInArrow(_anchors(window, part), "anchor long, doc_id long"))
    twice = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    flags = anchors.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # Left joins both, on the same columns of docs, so that they share one exchange of the texts.
    grams = docs.join(flags.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_flagged(window, part), "gram long, check int, doc_id long")
    lowest = grams.groupBy("gram", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "check", "low")
    gone = grams.join(lowest, ["gram", "check"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_cut(window, part), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT id, doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS g FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d)),
gone AS (SELECT id, pos FROM (SELECT id, doc_id, pos, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE doc_id > low),
covered AS (SELECT DISTINCT id, pos + k AS pos FROM gone, range(50) t(k)),
cut AS (SELECT id, list(pos) AS cut FROM covered GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN cut IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(cut, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (id)
"""

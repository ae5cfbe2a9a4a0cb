"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text (labelled good and not toxic) and one of raw text
(every document), give each document the importance weight p_target / p_raw. Documents are then drawn without
replacement in proportion to the weights: Gumbel top-k keeps the k largest of log weight + Gumbel noise.

Defined results: a null or text without words has weight 1 (log 0); equal doc_ids are separate rows with equal noise; ties at
the cut go to the smaller doc_id; very long texts are read whole; other columns are not read, whatever their names; an empty table gives an empty result; labels of unknown documents are ignored; several labels
of one document count as bad if one of them is; without any good label every document is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.lineage import materialize, small_batches

#: Documented bound of the labelled sample that the target model is fitted on.
MAX_LABELLED = 50_000
BUCKETS = 1 << 18
#: Tables with hashes of their own; of an n-gram's ratios the one nearest to 0 counts, so that one must share its buckets in all tables to be misjudged.
TABLES = 2
ORDERS = (1, 2)
#: A bucket's log ratio counts if its Poisson deviance from "as in raw text" and its size are at least these; else it is 0.
MIN_DEVIANCE, MIN_RATIO = 8.0, 1.3
#: Bytes of the beginnings of words (in lower case), which rare forms of a word share.
PREFIXES = (4, 5)
#: So many equal words in a row (and one before them) count as a feature.
RUN = 4
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SEED = 17


def features(words: tx.Words, buckets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Documents, buckets in each table and occurrences of their n-grams: words, word pairs, beginnings of words, what stands after a word's last letter or digit, and runs of one word."""
    h, doc, keys = words.hashes(), words.doc.astype(tx.U64), []
    bits = tx.U64(buckets.bit_length() - 1)
    both = bits * tx.U64(TABLES)
    put = lambda at, grams: keys.append((doc[at] << both) | (grams >> (tx.U64(64) - both)))
    for n in ORDERS:
        grams, at = words.windows(h, n)
        put(at, grams)
    if len(h):
        letters = np.maximum.accumulate(np.where(LETTER[words.data], np.arange(len(words.data)), -1))
        put(slice(None), tx.Words(words.data, np.maximum(letters[words.end - 1] + 1, words.start), words.end, words.first).hashes())
        for n in PREFIXES:
            at = np.flatnonzero(words.end - words.start >= n)
            start = words.start[at]
            put(at, tx.Words(tx.LOWER[words.data], start, start + n, words.first).hashes() ^ tx.U64(n))
        grams, at = words.windows((h == np.roll(h, 1)).astype(tx.U64), RUN)
        run = tx.rolling(np.ones(RUN, tx.U64), RUN)
        put(at[grams == run], np.full(int((grams == run).sum()), run[0]))
    keys = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + tx.U64(1)))
    keys, times = keys[at], np.diff(at, append=len(keys))
    in_table = [((keys >> (bits * tx.U64(k))) & tx.U64(buckets - 1)).astype(np.int64) + k * buckets for k in range(TABLES)]
    return (keys >> both).astype(np.int64), in_table, times


def labelled(labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id and good (labelled good and not toxic) of at most about ``bound`` labelled documents."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null")
    one = one.select("doc_id", ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    part = min(1.0, bound / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = MAX_LABELLED, prior: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket, 0 where the counts cannot tell it from raw text.

    Raw counts cover every document. Each task adds up its own counts and sends one row per bucket that it met. Occurrences
    count by their square root in each document; the numbers of documents decide what is significant.
    """
    known = labelled(labels, bound)
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"), F.col("good").isNotNull().alias("known"))
    names = ("raw", "target", "raw_docs", "known_docs", "target_docs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = TABLES * buckets
        sums = np.zeros((5, size))
        for batch in batches:
            good, known = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "known"))
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                doc, in_table, times = features(tx.words_of(data, offsets), buckets)
                of_good, of_known, root = good[lo:hi][doc], known[lo:hi][doc], np.sqrt(times)
                for b in in_table:
                    sums[0] += np.bincount(b, root, size)
                    sums[1] += np.bincount(b[of_good], root[of_good], size)
                    sums[2] += np.bincount(b, minlength=size)
                    sums[3] += np.bincount(b[of_known], minlength=size)
                    sums[4] += np.bincount(b[of_good], minlength=size)
        met = np.flatnonzero(sums[2])
        for i in range(0, len(met), 65_536):
            k = met[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(x[k].astype(np.float32)) for x in sums)], ["bucket", *names])

    small_batches(docs.sparkSession)
    found = marked.mapInArrow(count, "bucket int, " + ", ".join(f"{x} float" for x in names)).groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    sums = np.zeros((5, TABLES * buckets))
    for i, x in enumerate(names):
        sums[i, found.column("bucket").to_numpy()] = found.column(x).to_numpy()
    raw, target, raw_docs, known_docs, target_docs = sums
    if not target.sum():
        return np.zeros(TABLES * buckets, np.float32)
    ratio = np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))
    sure = np.abs(ratio) >= MIN_RATIO
    for base in (raw_docs, known_docs):  # labels may favour a language: what is as rare in all labelled text says nothing
        expected = base * (target_docs.sum() / base.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            deviance = 2 * (np.where(target_docs > 0, target_docs * np.log(target_docs / expected), 0) - (target_docs - expected))
        sure &= deviance >= MIN_DEVIANCE
    return np.where(sure, ratio, 0).astype(np.float32)


def log_weights(docs: DataFrame, model: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, log_weight (the sum of the model over the document's n-grams) and gumbel noise, for every document."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            weight, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                words = tx.words_of(data, offsets)
                doc, in_table, times = features(words, len(m) // TABLES)
                ratios = np.stack([m[b] for b in in_table])
                nearest = np.take_along_axis(ratios, np.abs(ratios).argmin(0)[None], 0)[0]
                weight[lo:hi] = np.bincount(doc, nearest * np.sqrt(times), hi - lo)
                grams[lo:hi] = words.counts
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(grams), pa.array(weight), pa.array(-np.log(-np.log(tx.uniform(ids, seed))))], ["doc_id", "n_words", "log_weight", "gumbel"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, log_weight double, gumbel double")


def top_k(scored: DataFrame, k: int, key: str, tie: str, exact_below: int = 100_000) -> DataFrame:
    """``scored`` with boolean kept for the k rows of the largest key, ties to the smaller tie; no total sort.

    Quantile sketches narrow the band that holds the k-th largest key until few rows lie in it; only those are ranked.
    """
    n = scored.count()
    if k >= n:
        return scored.withColumn("kept", F.lit(True))
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    low, high, above, inside = float("-inf"), float("inf"), 0, n
    band = scored
    while inside > exact_below:
        p = 1 - (k - above) / inside
        lo, hi = band.agg(F.percentile_approx(key, [max(0.0, p - 0.0005), min(1.0, p + 0.0005)], 10_000)).first()[0]
        over, within = band.agg(F.count_if(F.col(key) > hi), F.count_if(F.col(key).between(lo, hi))).first()
        if within >= inside or not over < k - above <= over + within:
            break
        low, high, above, inside = lo, hi, above + over, within
        band = scored.where(F.col(key).between(low, high))
    last = band.orderBy(F.col(key).desc(), F.col(tie)).limit(k - above).agg(F.min(key)).first()[0]
    taken = band.where(F.col(key) > last).count() + above
    tied = [r[0] for r in scored.where(F.col(key) == last).orderBy(tie).limit(k - taken).agg(F.max(tie)).collect()][0]
    # Rows of equal key and tie stand or fall together.
    return scored.withColumn("kept", (F.col(key) > last) | ((F.col(key) == last) & F.coalesce(F.col(tie) <= F.lit(tied), F.lit(False))))


def classify(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = MAX_LABELLED, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, log_weight, kept for every document. ``keep`` is the share to draw; by default as many as have a weight of one half or more."""
    model = fit(docs, labels, buckets, bound)
    scored = materialize(log_weights(docs, model, seed).withColumn("key", F.col("log_weight") + F.col("gumbel")))
    n, likely = scored.agg(F.count("*"), F.count_if(F.col("log_weight") >= -math.log(2))).first()
    k = likely if keep is None else round(keep * n)
    return top_k(scored, k, "key", "doc_id").select("doc_id", "n_words", "log_weight", "kept")

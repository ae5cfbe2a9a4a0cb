"""LM scoring: stupid backoff, computed relationally from count tables of n-grams.

A word after the context of the ``order`` - 1 words before it scores log(c(context word) / c(context)) if that n-gram occurs in the corpus; else 0.4 times the
score with a context that is one word shorter; without context log(c(word) / N). A document's score is the sum.

Scored under another corpus (``held_out``): with r(g) = log(c(g) / c(context of g)) and r(w) = log(c(w) / N) the score is, since an n-gram that occurs has a suffix that occurs,

    sum over words of r(w) + sum over k = 2 .. order and over k-grams g of [log 0.4 + (d(g) if g occurs in the corpus)],   d(g) = r(g) - log 0.4 - r(suffix of g)

so all orders are one join of exploded n-grams with a table of d (r for words), which is partitioned by hash, summed by document.

Scored under the documents themselves (``own_corpus``) every n-gram occurs, so nothing backs off, and the score is the sum of log c over the n-grams less that over their contexts. The exploded
n-grams are then dealt out by hash once: each is counted and looked up in that one place; lower orders come from count tables of their own.

Frequent n-grams are broadcast and scored where the text is read, so no n-gram that many documents hold goes through the join: at most ``HEAD`` of the lower orders by exact counts, at most ``HOT`` of the
highest order, which a sample of documents names and a pass over all of them counts.

Defined results: rows of equal doc_id (null too) are one document; a null text, or one without words, has score 0; a word that the corpus lacks counts as
occurring once; very long texts are read in one piece, and their n-grams beyond the broadcast tables go to the join one by one; an empty table gives an empty result; other
columns are not read, whatever their names. N-grams are compared by 64-bit hashes. Scores are rounded to 4 places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.lineage import materialize, small_batches
from spandrel.llm.ngram_counts import counts, frequent, known, ngrams, plain_counts

U64 = np.uint64
ORDER, BACKOFF = 2, 0.4
LOG_BACKOFF = math.log(BACKOFF)
#: N-grams of the highest order and of lower ones that are broadcast, 16 bytes each, and documents of the sample that names the first.
HOT, HEAD, SAMPLE = 65_536, 262_144, 10_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, head: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique ``key``), by a broadcast of its part ``head`` and a join for the others."""
    return rows.join(F.broadcast(head), key).unionByName(rows.join(F.broadcast(head.select(key)), key, "left_anti").join(table, key))


def rated(table: DataFrame, order: int, total: int, head: int) -> DataFrame:
    """order, gram, n and d (r for words) of every n-gram in ``table``, as counts() gives it."""
    below = materialize(table.where("order = 1").select("gram", "n", F.log(F.col("n") / F.lit(float(max(1, total)))).alias("r")))
    out = below.select(F.lit(1).alias("order"), "gram", "n", F.col("r").alias("d"))
    for k in range(2, order + 1):
        top = materialize(frequent(below, head))
        of = lambda c, value, name: (below.select(F.col("gram").alias(c), F.col(value).alias(name)), top.select(F.col("gram").alias(c), F.col(value).alias(name)))  # noqa: B023, E731
        with_context = looked_up(table.where(F.col("order") == k).select("gram", "n", "context", "suffix"), "context", *of("context", "n", "of")).drop("context")
        both = looked_up(with_context, "suffix", *of("suffix", "r", "shorter"))
        below = materialize(both.select("gram", "n", F.log(F.col("n") / F.col("of")).alias("r"), "shorter"))
        out = out.unionByName(below.select(F.lit(k).alias("order"), "gram", "n", (F.col("r") - F.lit(LOG_BACKOFF) - F.col("shorter")).alias("d")))
    return out


def exploded(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    """doc_id, gram, word, n_words and part: a row for each n-gram outside the table ``hot`` (hashes in order and d), and a row for each document with what the table gives."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, d = shared.value
        # The documents' own rows meet no n-gram; their keys only spread them.
        own = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                words = tx.words_of(data, offsets)
                total = np.zeros(hi - lo)
                for k, gram, _, _, doc in ngrams(words, order):
                    hit, at = known(table, gram)
                    total += np.bincount(doc[hit], d[at], hi - lo) + (np.bincount(doc, minlength=hi - lo) * LOG_BACKOFF if k > 1 else 0)
                    cold, n = gram[~hit], int((~hit).sum())
                    for i in range(0, n, 65_536):
                        part = cold[i : i + 65_536]
                        zero = np.zeros(len(part))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + doc[~hit][i : i + 65_536])), pa.array(part.view(np.int64)), pa.array(np.full(len(part), k == 1)), pa.array(zero.astype(np.int64)), pa.array(zero)], names)
                keys = own.integers(-(2**63), 2**63, hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(keys), pa.array([None] * (hi - lo), pa.bool_()), pa.array(words.counts), pa.array(total)], names)

    names = ["doc_id", "gram", "word", "n_words", "part"]
    return docs.mapInArrow(run, "doc_id long, gram long, word boolean, n_words long, part double")


def sorted_arrays(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a small ``table`` in order, and their ``value``."""
    found = table.select("gram", value).toArrow()
    gram, of = found.column("gram").to_numpy().view(U64), found.column(value).to_numpy()
    order = np.argsort(gram)
    return gram[order], of[order]


def held_out(docs: DataFrame, corpus: DataFrame, order: int, hot: int, head: int) -> DataFrame:
    """doc_id, n_words and score under the counts of ``corpus``."""
    table = materialize(counts(corpus, order))
    total = table.where("order = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rates = materialize(rated(table, order, total, head))
    rows = exploded(docs, sorted_arrays(frequent(rates, hot), "d"), order).join(rates.select("gram", "d"), "gram", "left")
    unknown: Column = F.when(F.col("word"), F.lit(-math.log(max(1, total)))).otherwise(0.0)
    value = F.col("part") + F.when(F.col("word").isNull(), F.lit(0.0)).otherwise(F.coalesce("d", unknown))
    return rows.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(value).alias("score"))


#: Weight that marks an n-gram of the highest order; n-grams of lower orders have -1, 0 or 1.
TOP = 9


def terms(words: tx.Words, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, weights and documents of the n-grams whose log counts make up the scores: the highest order's, and the contexts, which the first n-gram of a document cancels."""
    for k, gram, _, _, doc in ngrams(words, order):
        if k == order:
            yield gram, np.full(len(gram), TOP, np.int32), doc
        elif len(doc):
            first, last = np.append(True, doc[1:] != doc[:-1]), np.append(doc[1:] != doc[:-1], True)
            weight = first.astype(np.int32) - ~last if k == order - 1 else (first & last).astype(np.int32)
            some = weight != 0
            yield gram[some], weight[some], doc[some]


def own_corpus(docs: DataFrame, order: int, hot: int, head: int) -> DataFrame:
    """doc_id, n_words and score under the counts of the documents themselves."""
    spark = docs.sparkSession
    lower = materialize(plain_counts(docs, range(1, order)) if order > 1 else plain_counts(docs.limit(0), range(1, 2)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    named = np.sort(frequent(plain_counts(sample, range(order, order + 1)).where("n > 1"), hot).select("gram").toArrow().column("gram").to_numpy().view(U64))
    hot_grams, hot_n = sorted_arrays(plain_counts(docs, range(order, order + 1), named), "n")
    head_grams, head_n = sorted_arrays(frequent(lower, head), "n")
    words = docs.select(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((hot_grams, np.log(hot_n), head_grams, np.log(head_n), math.log(max(1, words))))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the broadcast tables give."""
        top, of_top, low, of_low, log_total = shared.value
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in tx.slices(batch.column("text")):
                found = tx.words_of(data, offsets)
                n[lo:hi] = found.counts
                total[lo:hi] -= log_total * (found.counts if order == 1 else np.minimum(found.counts, 1))
                for gram, weight, doc in terms(found, order):
                    highest = len(weight) > 0 and weight[0] == TOP
                    hit, at = known(top if highest else low, gram)
                    total[lo:hi] += np.bincount(doc[hit], (of_top if highest else of_low)[at] * (1 if highest else weight[hit]), hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total)], ["doc_id", "n_words", "score"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other n-grams."""
        top, _, low, _, _ = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in tx.slices(batch.column("text")):
                for gram, weight, doc in terms(tx.words_of(data, offsets), order):
                    cold = np.flatnonzero(~known(top if len(weight) and weight[0] == TOP else low, gram)[0])
                    for i in range(0, len(cold), 65_536):
                        at = cold[i : i + 65_536]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + doc[at])), pa.array(gram[at].view(np.int64)), pa.array(weight[at])], ["doc_id", "gram", "weight"])

    rows = docs.mapInArrow(explode, "doc_id long, gram long, weight int")
    # Counted where the rows meet: no n-gram of these is frequent.
    counted = rows.withColumn("here", F.count("*").over(Window.partitionBy("gram"))).join(lower, "gram", "left")
    value = F.when(F.col("weight") == TOP, F.log("here")).otherwise(F.col("weight") * F.log("n"))
    parts = counted.groupBy("doc_id").agg(F.sum(value).alias("score")).select("doc_id", F.lit(0).cast("long").alias("n_words"), "score")
    return docs.mapInArrow(sums, "doc_id long, n_words long, score double").unionAll(parts).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("score"))


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, hot: int = HOT, head: int = HEAD) -> DataFrame:
    """doc_id, n_words, score (natural log) and mean_score a word of every document, under the counts of ``corpus`` (by default the documents themselves)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = own_corpus(docs, order, hot, head) if corpus is None else held_out(docs, corpus, order, hot, head)
    return sums.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(F.col("score") / F.greatest(F.col("n_words"), F.lit(1)), 4).alias("mean_score"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w[pos] AS w, CASE WHEN pos > 1 THEN w[pos - 1] END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM t)),
c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM p GROUP BY w), n AS (SELECT sum(c) AS n FROM c1),
c2 AS MATERIALIZED (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
s AS (SELECT p.doc_id, CASE WHEN c2.c > 0 THEN ln(c2.c / cv.c) ELSE ln(cw.c / n.n) + CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM p JOIN c1 cw ON p.w = cw.w CROSS JOIN n LEFT JOIN c1 cv ON p.v = cv.w LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w),
g AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_words, round(coalesce(g.s, 0.0), 4) AS score, round(coalesce(g.s / g.n, 0.0), 4) AS mean_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""

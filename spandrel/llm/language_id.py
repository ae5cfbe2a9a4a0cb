"""Language identification, word first.

Words that the model knows score by their log frequency in each language. Other words fall back to their character n-grams, the longest
first, and to shorter ones while none is known. A document's scores are summed over its words.

The model is fitted on documents of the training folds (crc32 of the id modulo 4 is not 2) with a language, at most about ``MAX_TRAINING`` of them, by
counts in Spark, and keeps every word and n-gram of them. What is collected and broadcast is bounded by that sample.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if there is nothing to learn from; ties go to
the language that comes first by name; equal doc_ids are separate rows; a null doc_id is not held out and not learned from; very long texts are read
whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize, small_batches

#: Documented bound of the labelled documents that the model is fitted on.
MAX_TRAINING = 20_000
LONGEST = 5
#: Log probability of a known word or n-gram in a language that lacks it, below that of one occurrence.
MISSING = -1.0
WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores a task remembers, and those that it looks up at once.
REMEMBERED, NEW_WORDS = 100_000, 50_000


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training(docs: DataFrame, bound: int = MAX_TRAINING) -> DataFrame:
    """lang and lower-case text of at most about ``bound`` documents of the training folds."""
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    part = min(1.0, bound / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)).select("lang", F.lower("text").alias("text"))


@dataclass
class Model:
    """Languages; words, and n-grams of each length, in the order of their rows in ``rates``, log frequencies in each language.

    Keys stay Arrow strings: every worker of an executor holds a model, and dicts of them took several times the memory.
    """

    langs: list[str]
    words: pa.Array
    grams: list[pa.Array]
    rates: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """One row of scores for each of ``words``, which are looked up together."""
        out = np.zeros((len(words), len(self.langs)))
        at = _places(words, self.words)
        out[at >= 0] = self.rates[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        firsts = np.cumsum([len(self.words), *map(len, self.grams)])
        for n in range(len(self.grams), 0, -1):
            cut = [[marked[i : i + n] for i in range(len(marked) - n + 1)] for w in left if (marked := f"^{words[w]}$")]
            at = _places([g for gs in cut for g in gs], self.grams[n - 1])
            ends, unknown = np.cumsum([len(gs) for gs in cut]), []
            for w, gs, end in zip(left, cut, ends, strict=True):
                known = at[end - len(gs) : end]
                known = known[known >= 0]
                if len(known):
                    out[w] = self.rates[firsts[n - 1] + known].mean(axis=0, dtype=np.float64)
                else:
                    unknown.append(w)
            left = unknown
        return out


def _places(keys: list[str], table: pa.Array) -> np.ndarray:
    """Row of each key in ``table``, -1 if it has none."""
    return pc.index_in(pa.array(keys, table.type), value_set=table).fill_null(-1).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, bound: int = MAX_TRAINING) -> Model:
    """Every word of the labelled documents, and every n-gram of their words, with its frequency in each language."""
    words = materialize(training(docs, bound).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")))
    marked = F.concat(F.lit("^"), "key", F.lit("$"))
    grams_of = lambda k: F.when(F.length(marked) >= k, F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.struct(F.lit(k).alias("size"), F.substr(marked, i, F.lit(k)).alias("key"))))
    grams = words.select("lang", "n", F.explode(F.flatten(F.array_compact(F.array(*(grams_of(k) for k in range(1, LONGEST + 1)))))).alias("g")).groupBy("lang", F.col("g.size").alias("size"), F.col("g.key").alias("key")).agg(F.sum("n").alias("n"))
    counts = materialize(words.select("lang", F.lit(0).alias("size"), "key", "n").unionAll(grams.select("lang", "size", "key", "n")))
    totals = {(lang, size): n for lang, size, n in counts.groupBy("lang", "size").agg(F.sum("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    # One row a word or n-gram: log frequency where it occurs, below that of one occurrence where not.
    lowest = F.create_map(*(F.lit(x) for (lang, size), n in totals.items() for x in (f"{size} {lang}", MISSING - math.log(max(2, n))))) if totals else F.create_map().cast("map<string,double>")
    total_of = F.create_map(*(F.lit(x) for (lang, size), n in totals.items() for x in (f"{size} {lang}", float(n)))) if totals else lowest
    of = lambda lang: F.concat_ws(" ", F.col("size").cast("string"), F.lit(lang))
    rate = lambda lang: F.coalesce(F.log(F.max(F.when(F.col("lang") == lang, F.col("n"))) / F.max(F.try_element_at(total_of, of(lang)))), F.max(F.try_element_at(lowest, of(lang))), F.lit(MISSING - math.log(2))).cast("float")
    if not langs:
        return Model([], pa.array([], pa.string()), [pa.array([], pa.string())] * LONGEST, np.zeros((0, 0), np.float32))
    found = counts.groupBy("size", "key").agg(*(rate(lang).alias(f"r{i}") for i, lang in enumerate(langs))).toArrow()
    found = found.sort_by("size")
    sizes = found.column("size").to_numpy()
    tables = [pa.concat_arrays(found.column("key").slice(a, b - a).chunks or [pa.array([], pa.string())]) for k in range(LONGEST + 1) for a, b in [np.searchsorted(sizes, [k, k + 1])]]
    return Model(langs, tables[0], tables[1:], np.stack([found.column(f"r{i}").to_numpy() for i in range(len(langs))], axis=1))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index: dict[str, int] = {}
        scores = np.zeros((0, len(m.langs)))
        for batch in batches:
            preds, sure = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            new: list[str] = []
            waiting: list[tuple[int, np.ndarray]] = []
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                words = WORD.findall(text.lower()) if text and m.langs else []
                if words and (any(w.isalpha() for w in words) or any(c.isalpha() for c in text)):
                    at = []
                    for w in words:
                        i = index.get(w)
                        if i is None:
                            i = index[w] = len(index)
                            new.append(w)
                        at.append(i)
                    waiting.append((row, np.array(at, np.int32)))
                if len(new) < NEW_WORDS and row + 1 < batch.num_rows:
                    continue
                scores = np.concatenate((scores, m.scores(new)))
                for doc, at in waiting:
                    unique, times = np.unique(at, return_counts=True)
                    total = scores[unique].T @ times
                    odds = np.exp((total - total.max()) / np.sqrt(len(at)))
                    best = int(total.argmax())
                    preds[doc], sure[doc] = m.langs[best], float(odds[best] / odds.sum())
                new, waiting = [], []
                if len(index) > REMEMBERED:
                    index, scores = {}, scores[:0]
            ids = batch.column("doc_id")
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(preds, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")

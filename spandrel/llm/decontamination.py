"""Benchmark decontamination by spaced seeds, with built-in functions only.

A mask fixes which of some consecutive words are hashed; the others may differ. Each length of item has masks such that every alignment that
agrees in enough words shares a seed. Seeds of the benchmark are joined to those of the documents; around each hit the two texts are laid side by side, and the pair overlaps if some window of ``WINDOW`` aligned
words (or the whole item, if shorter) agrees in at least ``AGREE`` of its words. Letters are compared in lower case.

Seeds of the benchmark are broadcast while they and the items' words are few; beyond ``MAX_BROADCAST`` rows both sides are shuffled by hash. Texts never go
through the seed join: only ids, positions and hashes do. Texts with hits are read again; the hits are broadcast to them while they are few, else both are shuffled.

Defined results: a null text is clean; an item of fewer than ``min_words`` words or without words is found in no document; rows of equal
doc_id share a verdict; a null doc_id is not judged (clean); repeated items count once each item_id; of equal overlaps the smallest item_id is
reported; very long texts are searched whole; other columns are kept by clean() and not read, whatever their names; empty tables give clean documents or an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize

#: Least and greatest words of an item, and its masks; a longer item has those of ``WINDOW`` words.
MASKS = (
    (13, 13, ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 2, 4, 9, 11))),
    (7, 12, ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6))),
    (5, 6, ((0, 1, 2), (0, 3, 4))),
    (4, 4, ((0, 1, 2), (0, 1, 3), (0, 2, 3))),
    (3, 3, ((0, 1, 2),)),
    (2, 2, ((0, 1),)),
    (1, 1, ((0,),)),
)
WINDOW, AGREE = 13, 0.75
#: Rows of 24 bytes, and words of items of 8 bytes, that may be broadcast.
MAX_BROADCAST = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, classes: list[int]) -> Column:
    """For each mask of ``classes`` (places in MASKS), a hash at each position up to the last at which the mask fits."""

    def of(c: int, k: int, mask: tuple[int, ...]) -> Column:
        fits = F.greatest(F.lit(0), F.size(words) - mask[-1])
        return F.transform(F.slice(words, F.lit(1), fits), lambda w, i: F.struct(i.alias("at"), F.xxhash64(F.lit(10 * c + k), w, *(F.get(words, i + o) for o in mask[1:])).alias("seed")))

    return F.concat(*(of(c, k, m) for c in classes for k, m in enumerate(MASKS[c][2])))


def seed_rows(table: DataFrame, key: str, classes: list[int]) -> DataFrame:
    """key, at (position of the seed's first word) and seed of every text in ``table`` (key, words)."""
    return table.select(key, F.inline(seeds(F.col("words"), classes)))


def overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST, min_words: int = 1) -> DataFrame:
    """doc_id, item_id and agreeing (the most words that agree in a window) of each overlapping pair, once for each alignment."""
    # Items without words are left out, so that few seeds mean few items and few words.
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("item_words")).where(F.size("item_words") >= max(1, min_words))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    words = F.col("words")
    length = F.least(F.size(words), F.lit(WINDOW))
    by_words = items.withColumnRenamed("item_words", "words")
    met = {n for (n,) in by_words.select(length).distinct().collect()}
    # Documents get the seeds of the lengths that the benchmark has.
    classes = [c for c, (least, most, _) in enumerate(MASKS) if any(least <= n <= most for n in met)] or [0]
    of_class = lambda c: seed_rows(by_words.where(length.between(*MASKS[c][:2])), "item_id", [c])
    item_seeds = reduce(DataFrame.unionAll, map(of_class, classes)).select("item_id", F.col("at").alias("item_at"), "seed").distinct()
    small = item_seeds.count() <= max_broadcast and (items.agg(F.sum(F.size("item_words"))).first()[0] or 0) <= max_broadcast
    hits = seed_rows(texts.select("doc_id", word_hashes(F.col("text")).alias("words")), "doc_id", classes).join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    aligned = materialize(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    few = aligned.count() <= max_broadcast
    # Only texts with hits are read again and hashed anew; few hits go to the texts, not the texts to them.
    ids = aligned.select("doc_id").distinct()
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("words"))
    # Alignments are broadcast without the items' words, which are broadcast once or else join them.
    if small:
        pairs = texts.join(F.broadcast(aligned) if few else aligned, "doc_id").join(F.broadcast(items), "item_id")
    else:
        pairs = texts.join(aligned.join(items, "item_id"), "doc_id")
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_words"), F.size("words") - F.col("shift"))
    pairs = pairs.select("doc_id", "item_id", F.least(F.lit(WINDOW), F.size("item_words")).alias("window"), F.transform(F.sequence(first, last - 1), lambda k: (F.get("words", k + F.col("shift")) == F.get("item_words", k)).cast("int")).alias("same"))
    pairs = pairs.where(F.size("same") >= F.col("window"))
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("window") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("window")), F.lit(0), lambda a, x: a + x))
    return pairs.select("doc_id", "item_id", "window", F.array_max(windows).alias("agreeing")).where(F.col("agreeing") >= F.ceil(F.col("window") * AGREE))


def judge(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST, min_words: int = 1) -> DataFrame:
    """doc_id, contaminated, n_items, best_item and agreeing (of the best item) of every document."""
    found = overlaps(docs, benchmark, max_broadcast, min_words).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max(F.struct("agreeing", -F.col("item_id"))).alias("best"))
    found = found.select("doc_id", "n_items", (-F.col("best.col2")).alias("best_item"), F.col("best.agreeing").alias("agreeing"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best_item", F.col("agreeing").cast("long").alias("agreeing"))


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents without an overlap, all columns."""
    return docs.join(overlaps(docs, benchmark, min_words=min_words).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


#: Compares every alignment that shares a word, without seeds. The most words that agree in a window are found in one that begins with an agreeing word
#: (or ends with the alignment).
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dw AS (SELECT id, doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS pos FROM d),
bw AS (SELECT item_id, len(w) AS m, unnest(w) AS w, unnest(range(len(w))) AS k FROM b),
same AS (SELECT id, doc_id, item_id, m, least(13, m) AS win, pos - k AS shift, k FROM dw JOIN bw USING (w) WHERE least(m, n - (pos - k)) - greatest(0, k - pos) >= least(13, m)),
o AS (SELECT doc_id, item_id, win, count(*) OVER (PARTITION BY id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS agreeing FROM same),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(struct_pack(a := agreeing, i := -item_id)) AS best FROM o WHERE agreeing >= ceil(win * 0.75) GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(-best.i AS BIGINT) AS best_item, CAST(best.a AS BIGINT) AS agreeing
FROM documents LEFT JOIN g USING (doc_id)
"""

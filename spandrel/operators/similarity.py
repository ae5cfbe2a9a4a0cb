"""Clone candidates: equal signatures, then token similarity, then a verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.scalar import jaccard, tokens
from spandrel.operators.storage import bounded_batches, written

THRESHOLD = 0.5
#: Bytes of prints that a bucket holds, and sets at most.
BUCKET_BYTES, BUCKET_SETS = 2 << 20, 16_384
#: Bits of a print: eight times the least size of its class, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 14
#: Pairs that are compared at once in a task.
TILE = 1 << 18


def width(level: int) -> int:
    """Bits of the prints of sets with 2 ** level words or more, and fewer than twice as many."""
    return min(MOST_BITS, max(LEAST_BITS, 8 << level))


def prints(sets: DataFrame, key: list[str]) -> DataFrame:
    """key, set, n, level and print: bit b of a print is the parity of the words whose hash is b modulo its width.

    A word that only one of two sets has changes one bit, so prints differ in at most as many bits as the sets differ in words. A wider print is folded to a narrower one by exclusive or of its halves.
    """
    names = [*key, "set", "n", "level"]
    level = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    bounded_batches(sets.sparkSession)
    hashed = sets.where(F.size("words") > 0).select(*key, "set", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).select(*key, "set", "n", level.alias("level"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, lists = batch.column("level").to_numpy(), batch.column("h")
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: list[bytes] = [b""] * batch.num_rows
            for x in np.unique(levels):
                bits, rows = width(int(x)), np.flatnonzero(levels == x)
                for part in np.array_split(rows, max(1, len(rows) * bits // (1 << 22))):
                    sizes = starts[part + 1] - starts[part]
                    at = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                    cell = np.repeat(np.arange(len(part)), sizes) * bits + (values[at] & (bits - 1))
                    odd = (np.bincount(cell, minlength=len(part) * bits) & 1).astype(np.uint8).reshape(len(part), bits)
                    for i, packed in zip(part, np.packbits(odd, axis=1, bitorder="little"), strict=True):
                        out[i] = packed.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "print"])

    types = dict(hashed.dtypes)
    return hashed.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", print binary")


def _folded(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    """Prints of one width as rows of 64-bit words, folded to ``bits``."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    while rows.shape[1] * 64 > bits:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return np.ascontiguousarray(rows.T)


def _near(cell: pa.Table, key: list[str], threshold: float) -> pa.Table:
    """Pairs of a cell (two buckets, or one with itself) whose prints and sizes allow the threshold."""
    sides = [cell.filter(pc.equal(cell.column("side"), i)) for i in (0, 1)]
    alone = not sides[1].num_rows and cell.column("i").equals(cell.column("j")) and cell.column("level").equals(cell.column("with"))
    a = sides[0].sort_by("n")
    b = a if alone else sides[1].sort_by("n")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if a.num_rows and b.num_rows:
        n, m = (s.column("n").to_numpy().astype(np.int64) for s in (a, b))
        bits = width(int(cell.column("level")[0].as_py()))
        left, right = _folded(a.column("print"), bits), _folded(b.column("print"), bits)
        step = max(1, TILE // len(m))
        for at in range(0, len(n), step):
            here = slice(at, at + step)
            # Both sides are sorted by size: sets too large or too small for all of these are not compared.
            lo = np.searchsorted(m, n[at] * threshold - 1e-9)
            hi = np.searchsorted(m, n[here][-1] / threshold + 1e-9, side="right")
            if alone:
                lo = max(lo, at)
            if lo >= hi:
                continue
            apart = np.zeros((len(n[here]), hi - lo), np.int32)
            for x, y in zip(left[:, here], right[:, lo:hi], strict=True):
                apart += np.bitwise_count(x[:, None] ^ y[None, :])
            near = apart <= (n[here][:, None] + m[None, lo:hi]) * ((1 - threshold) / (1 + threshold)) + 1e-9
            p, q = np.nonzero(near)
            p, q = p + at, q + lo
            if alone:
                p, q = p[p < q], q[p < q]
            found.append((p, q))
    p, q = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    one, other = a.column("set").take(pa.array(p)), b.column("set").take(pa.array(q))
    keys = [pa.array([cell.column(k)[0].as_py()] * len(p), cell.schema.field(k).type) for k in key]
    return pa.table([*keys, one, other], names=[*key, "one", "other"])


def similar_sets(sets: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """key, one, other (one < other) and similarity of different token sets (key columns, set, words) that are alike.

    Sets of one key are dealt into buckets by level (the power of two in their size) and hash. Two sets that are alike have equal or near levels, so each bucket meets those of its own
    level and the ones above that the threshold allows, one pair of buckets a task. There prints are compared (``prints``): alike sets of a and b words differ in (1 - threshold) / (1 + threshold) of a + b words at
    most, and their prints in no more bits, so no pair is lost. Only pairs that pass go on, to the words themselves. A set goes to as many tasks as there are buckets near its own; no pair is shuffled that was not near.
    """
    reach = int(np.ceil(-np.log2(threshold) - 1e-9))
    p = written(prints(sets, key))
    share = F.ceil(F.count("*") * F.max(F.length("print")) / BUCKET_BYTES)
    counts = written(p.groupBy(*key, "level").agg(F.greatest(share, F.ceil(F.count("*") / BUCKET_SETS)).cast("int").alias("k")))
    near = lambda d: counts.select(*key, (F.col("level") - d).alias("level"), F.col("k").alias("l"))
    dealt = p.join(counts, [*key, "level"]).withColumn("b", F.pmod(F.xxhash64("set"), F.col("k")).cast("int"))
    cell = [*key, "level", "with", "i", "j"]
    rest = ["set", "n", "print"]
    each = lambda a, b: F.explode(F.sequence(a, b))
    here = dealt.select(*key, "level", F.col("level").alias("with"), *rest, "b", each(F.lit(0), F.col("k") - 1).alias("o"))
    parts = [here.select(*key, "level", "with", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), *rest)]
    for d in range(1, reach + 1):
        up = dealt.join(near(d), [*key, "level"]).select(*key, "level", (F.col("level") + d).alias("with"), F.col("b").alias("i"), each(F.lit(0), F.col("l") - 1).alias("j"), F.lit(0).alias("side"), *rest)
        down = dealt.join(near(-d), [*key, "level"]).select(*key, (F.col("level") - d).alias("level"), F.col("level").alias("with"), each(F.lit(0), F.col("l") - 1).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), *rest)
        parts += [up, down]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    types = dict(sets.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), f"one {types['set']}", f"other {types['set']}"])
    met = cells.groupBy(*cell).applyInArrow(lambda t: _near(t, key, threshold), schema)
    met = written(met.select(*key, F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")))
    left = sets.select(*key, F.col("set").alias("one"), F.col("words").alias("a"))
    right = sets.select(*key, F.col("set").alias("other"), F.col("words").alias("b"))
    both = met.join(left, [*key, "one"]).join(right, [*key, "other"])
    return both.select(*key, "one", "other", jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)


def candidates(new: DataFrame, known: DataFrame, key: list[str], threshold: float = THRESHOLD, judge: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs (new_id, known_id, similarity, is_similar) of equal ``key`` and similarity of ``threshold`` or more.

    Both sides: id, text and the key columns. A row is never its own candidate, and a null key or text has none. Equal token sets are compared once, whatever the
    number of their copies. ``judge`` turns the similarity into a verdict; by default all candidates are similar.
    """
    worded = lambda d, side: d.select(*key, "id", F.lit(side).alias("side"), F.array_sort(tokens("text")).alias("words")).dropna(subset=[*key, "words"])
    every = worded(new, "both") if new is known else worded(new, "new").unionAll(worded(known, "known"))
    every = every.withColumn("set", F.sha2(F.concat_ws(" ", "words"), 256))
    rows = written(every.drop("words"))
    sets = written(every.groupBy(*key, "set").agg(F.any_value("words").alias("words")))
    found = similar_sets(sets, key, threshold)
    flipped = found.select(*key, F.col("other").alias("one"), F.col("one").alias("other"), "similarity")
    same = sets.select(*key, F.col("set").alias("one"), F.col("set").alias("other"), F.lit(1.0).alias("similarity"))
    a = rows.where("side <> 'known'").select(*key, F.col("set").alias("one"), F.col("id").alias("new_id"))
    b = rows.where("side <> 'new'").select(*key, F.col("set").alias("other"), F.col("id").alias("known_id"))
    out = found.unionByName(flipped).unionByName(same).join(a, [*key, "one"]).join(b, [*key, "other"]).where(F.col("new_id") != F.col("known_id"))
    return out.select("new_id", "known_id", "similarity").withColumn("is_similar", judge(F.col("similarity")) if judge else F.lit(True))


def clone_classes(functions: DataFrame, key: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (id, clone_class) and links (one, other, similarity) of ``functions`` (id, text, key columns): a class holds the rows of equal key and token set and is called by its smallest id.

    Copies are members and are not compared; links join different classes of one key that are alike. Rows with a null key or text are left out.
    """
    every = functions.select(*key, "id", F.array_sort(tokens("text")).alias("words")).dropna(subset=[*key, "words"]).withColumn("set", F.sha2(F.concat_ws(" ", "words"), 256))
    rows = written(every.drop("words"))
    sets = written(every.groupBy(*key, "set").agg(F.any_value("words").alias("words"), F.min("id").alias("clone_class")))
    found = similar_sets(sets.select(*key, "set", "words"), key, threshold)
    named = lambda c, to: sets.select(*key, F.col("set").alias(c), F.col("clone_class").alias(to))
    links = found.join(named("one", "a"), [*key, "one"]).join(named("other", "b"), [*key, "other"]).select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other"), "similarity")
    return rows.join(sets.select(*key, "set", "clone_class"), [*key, "set"]).select("id", "clone_class"), links

"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has a bit for each position that is set in over half of the hashes of a document's word shingles. Sorted
fingerprints are an implicit binary trie. Its self-join walks pairs of nodes together, adds up the bits in which their
prefixes differ, and drops a pair as soon as these exceed the budget.

Wide fingerprints are cut into bands of equal width, each with a trie and a budget of its own: if two fingerprints differ in at
most ``bands * (budget + 1) - 1`` bits, they differ in at most ``budget`` bits of some band, so no link is lost; the whole
fingerprints are compared at the leaves. Work is dealt out by pairs of trie prefixes within the budget, and equal
fingerprints are one row before that, so neither copies nor a hot source gather in a task. A task reports a spanning forest
of the links that it finds, which has the same components as all of them.

A similarity of shingle sets needs no fingerprints: see ``similar_sets``.

Defined results: a null text or one without words has fingerprint zero; fewer words than a shingle are one shingle; rows with
equal doc_id are separate rows of one component; null doc_ids get a component through other members of their group,
null if there are none; a group whose ids are all null is linked to no other one; very long texts are read whole; other columns are not read, whatever their
names, and kept by one_of_each(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import text as tx
from spandrel.llm.components import components
from spandrel.llm.hot_keys import joined_back
from spandrel.llm.lineage import materialize, small_batches

U64 = np.uint64
#: For each byte value, its bits in eight lanes of eight bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(U64).ravel()
#: Distinct fingerprints that one side of a trie task should hold, and bits of prefix at most.
TASK_ROWS, MAX_PREFIX = 250_000, 8


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints (documents x words of 64 bits) from the hashes (n x words) of documents first[d] to first[d + 1]."""
    counts = np.diff(first)
    out = np.zeros((len(counts), hashes.shape[1]), U64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    # Lanes hold up to 255, so documents are summed in blocks of 255 hashes.
    blocks = -(-counts[filled] // 255)
    block_doc = np.repeat(np.arange(len(filled)), blocks)
    start = first[:-1][filled][block_doc] + 255 * (np.arange(len(block_doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    lanes = np.add.reduceat(LANES[np.ascontiguousarray(hashes).view(np.uint8)], start, axis=0)
    bits = np.add.reduceat(lanes.view(np.uint8).astype(np.int32), np.cumsum(blocks) - blocks, axis=0)
    bits = bits.reshape(len(filled), -1) * 2 > counts[filled][:, None]
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view(U64)
    return out


def widened(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of ``bits`` bits from those of 64."""
    return np.stack([h] + [tx.mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, bits // 64)], axis=1)


def shingle_hashes(words: tx.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles, and where each document's begin. Fewer words than ``width`` are one shingle."""
    counts = words.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    begin = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    raw = words.data.tobytes()
    joined = b" ".join([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
    doc = np.repeat(np.arange(len(counts)), shingles)
    at = words.first[:-1][doc] + np.arange(len(doc)) - first[doc]
    last = np.minimum(at + width, words.first[1:][doc])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin[at].tolist(), (begin[last] - 1).tolist(), strict=True)), U64, len(doc)), first


def rolling_hashes(words: tx.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the shingles, and where each document's begin; for fingerprints whose hash is free to choose."""
    counts, h = words.counts, words.hashes()
    grams, at = words.windows(h, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        # A short document is one shingle: its word hashes, summed with their positions.
        doc = words.doc
        place = np.arange(len(h)) - words.first[:-1][doc]
        up, _ = tx.powers(width)
        whole = tx.mix(np.add.reduceat(h * up[np.minimum(place, width - 1)], words.first[:-1][short]) if len(short) == (counts > 0).sum() else np.array([(h[words.first[d] : words.first[d + 1]] * up[: counts[d]]).sum(dtype=U64) for d in short], U64))
        order = np.argsort(np.concatenate([at, words.first[:-1][short]]), kind="stable")
        grams = np.concatenate([grams, whole])[order]
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return grams, np.concatenate([[0], np.cumsum(shingles)])


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document in order, and where each document's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(first) - 1))])


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set, from its distinct hashes."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(tx.mix(h ^ U64(seed)), dtype=U64)]) for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)]
    return sums[0][first[1:]] - sums[0][first[:-1]], sums[1][first[1:]] - sums[1][first[:-1]]


def fingerprints(docs: DataFrame, width: int, bits: int = 64, xxh64: bool = True) -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each, as longs) of every document. A-Z is lower-cased."""
    n = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, n), U64)
            for lo, hi, data, offsets in tx.slices(batch.column("text"), 1 << 19):
                words = tx.words_of(tx.LOWER[data], offsets)
                h, first = shingle_hashes(words, width) if xxh64 else rolling_hashes(words, width)
                out[lo:hi] = majority(widened(h, bits), first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T)], ["doc_id", *names])

    names = [f"f{k}" for k in range(n)]
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int, budget: int, leaf: int = 16, chunk: int = 1 << 17, roots: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i into a, j into b) of sorted values that differ in at most ``budget`` of their low ``bits`` bits; without b, pairs i < j of a.

    Values are 64-bit words, or rows of such words, the first one on top. ``roots`` (begins and ends) are parts of ``a`` that are sorted and joined each with itself alone.
    Node pairs wait on a stack in chunks, so memory stays bounded however many there are.
    """
    own = b is None
    if not len(a) or not own and not len(b):
        return
    a = a.reshape(len(a), -1)
    b = a if own else b.reshape(len(b), -1)
    ranks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def zeros(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in ranks:
            word, shift = a.shape[1] - 1 - (bits - 1 - level) // 64, U64((bits - 1 - level) % 64)
            rank = lambda x: np.concatenate([[0], np.cumsum((x[:, word] >> shift) & U64(1) == 0)])
            ranks[level] = (z := rank(a), z if own else rank(b))
        return ranks[level]

    one = np.array([0])
    a0, a1 = roots or (one, one + len(a))
    b0, b1 = (a0, a1) if own else (one, one + len(b))
    stack = [(0, a0, a1, b0, b1, np.zeros(len(a0), np.int64))]
    while stack:
        level, a0, a1, b0, b1, d = stack.pop()
        if len(d) > chunk:
            stack.append((level, *(x[chunk:] for x in (a0, a1, b0, b1, d))))
            a0, a1, b0, b1, d = (x[:chunk] for x in (a0, a1, b0, b1, d))
        done = ((a1 - a0) * (b1 - b0) <= leaf) | (level == bits)
        if done.any():
            p0, p1, q0, q1 = (x[done] for x in (a0, a1, b0, b1))
            for node, k in pieces((p1 - p0) * (q1 - q0)):
                width = (q1 - q0)[node]
                i, j = p0[node] + k // width, q0[node] + k % width
                near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= budget
                if own:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
            a0, a1, b0, b1, d = (x[~done] for x in (a0, a1, b0, b1, d))
        if not len(d):
            continue
        za, zb = zeros(level)
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        same = (a0 == b0) & (a1 == b1) if own else np.zeros(len(d), bool)
        kids = []
        for x0, x1, y0, y1, more, keep in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (d + more <= budget)
            if keep is not None:
                ok &= keep
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok] + more))
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))


def pieces(counts: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of sum(counts) things: whose it is and its number there, about ``most`` at a time; a count may be larger."""
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(lo, min(lo + most, int(ends[-1])))
        of = np.searchsorted(ends, k, "right")
        yield of, k - (ends[of] - counts[of])


class Forest:
    """Joins of the nodes 0 to n - 1; ``links`` are those that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((lo, hi))
            first = order[np.flatnonzero(np.diff(hi[order], prepend=-1))]  # each larger root goes below one smaller root
            self.links += zip(i[first].tolist(), j[first].tolist(), strict=True)
            self.root[hi[first]] = lo[first]
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def links(prints: DataFrame, bits: int, max_distance: int, bands: int = 1, budget: int | None = None) -> DataFrame:
    """u and v of links between the rows (node, f0, f1, ...) of different fingerprints: spanning forests of each task's."""
    names = [c for c in prints.columns if c.startswith("f")]
    width = bits // bands
    budget = (max_distance + 1 + bands - 1) // bands - 1 if budget is None else budget
    n = prints.count()
    prefix = min(MAX_PREFIX, max(3 if bands == 1 else 2, int(np.ceil(np.log2(max(1, n) / TASK_ROWS)))))
    spark = prints.sparkSession
    near = [(p, min(p, q), max(p, q)) for p in range(1 << prefix) for q in range(1 << prefix) if (p ^ q).bit_count() <= budget]
    # 4 ** MAX_PREFIX rows at most
    units = F.broadcast(spark.createDataFrame(near, "prefix int, low int, high int"))
    per_word = 64 // width

    def band(k: int) -> DataFrame:
        value = F.shiftrightunsigned(F.col(names[k // per_word]), width * (k % per_word))
        at = F.shiftrightunsigned(value, width - prefix).bitwiseAND(F.lit((1 << prefix) - 1)).cast("int")
        return prints.select(F.lit(k).alias("band"), at.alias("prefix"), "node", *names)

    dealt = reduce(DataFrame.unionAll, [band(k) for k in range(bands)]).join(units, "prefix")

    def run(table: pa.Table) -> pa.Table:
        k, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        words = np.stack([table.column(c).to_numpy().view(U64) for c in names], axis=1)
        value = words[:, k // per_word] >> U64(width * (k % per_word))
        if width < 64:
            value &= U64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        value, words, node = value[order], words[order], table.column("node").to_numpy()[order]
        cut = len(value) if low == high else int(np.searchsorted(value >> U64(width - prefix), U64(high)))
        forest = Forest(len(value))
        for i, j in trie_pairs(value[:cut], None if low == high else value[cut:], width, budget):
            j = j + (0 if low == high else cut)
            if len(names) > 1:
                apart = sum(np.bitwise_count(words[i, w] ^ words[j, w]).astype(np.int32) for w in range(len(names)))
                i, j = i[apart <= max_distance], j[apart <= max_distance]
            forest.add(i, j)
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"u": node[found[:, 0]], "v": node[found[:, 1]]})

    return dealt.groupBy("band", "low", "high").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 64, max_distance: int = 3, bands: int = 1, xxh64: bool = True, budget: int | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, f0, f1, ... and component_id (the smallest doc_id reachable over links) of every document.

    With ``similarity``, links are the pairs of that Jaccard similarity, and f0 and f1 are hashes of the shingle set.
    """
    if similarity is not None:
        from spandrel.llm import similar_sets

        return similar_sets.groups(docs, width, similarity)
    prints = materialize(fingerprints(docs, width, bits, xxh64))
    names = [c for c in prints.columns if c != "doc_id"]
    groups = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    found = components(links(groups.drop("rows").where("node is not null"), bits, max_distance, bands, budget).select("u", "v"))
    groups = materialize(groups.join(found, "node", "left").select(*names, "rows", F.coalesce("component", "node").alias("component_id")))
    return joined_back(prints, groups, names).select("doc_id", *names, "component_id")


SIMILAR = {"width": 5, "similarity": 0.8}


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8 or more), all columns.

    Rows with a null doc_id stay; of rows with an equal doc_id one stays.
    """
    groups = near_duplicates(docs, **SIMILAR)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.where("doc_id is null"))

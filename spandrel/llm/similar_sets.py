"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints, joined by their binary trie, then checked exactly.

At a similarity of 0.8 fingerprints of ``BITS`` bits differ in 15 to 19 % of them, too many for trie prefixes to deal the work out. So it is dealt by
shingles: in one order of all shingles (rarer ones of a sample first, then by hash) two sets of a similarity of ``t`` or more share one of the
first n - ceil(t n) + 1 of each, whatever the sample. In each such meeting place the trie of the fingerprints is joined with itself under
an error budget of ``BUDGET`` bits; a pair of similar sets exceeds it with a chance below 2e-9. A task reports no pairs but a spanning forest of what it
finds, so the links of a place are fewer than its rows.

Documents with equal sets are one node before that. First each node is compared with two neighbours among those that it meets; these links leave
few nodes apart. The trie joins cover the places where components still meet, and the components of their candidates (cells) are checked inside a task:
the cell's shingle sets are sent there once, its trie is joined once more, nearest pairs first, and pairs of different components are compared by exact
Jaccard, so again a spanning forest comes out. Hot places and large cells are cut into blocks, each pair of blocks a task.

Defined results are those of ``simhash``: a null text or one without words has an empty set, and such documents are one class; fewer words than a shingle are one shingle; very long texts are read whole;
rows of equal doc_id are rows of one class; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import simhash
from spandrel.llm import text as tx
from spandrel.llm.components import components
from spandrel.llm.hot_keys import blocks_of_hot_keys, joined_back
from spandrel.llm.lineage import materialize, small_batches

U64 = np.uint64
#: Documents of the sample and its commonest shingles: these set the order alone.
SAMPLE, COMMON = 10_000, 300_000
#: Rows (a shingle of a document) of one task, and rows of one shingle or bytes of one cell beyond which it is cut into blocks.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1_000_000, 16_384, 1 << 24
BITS, BUDGET = 256, 88
#: Distances at which the pairs of a cell are tried, nearest ones first.
STEPS = (24, 48, BUDGET)
PRINT = [f"f{k}" for k in range(BITS // 64)]
#: Shingles that one step of exact comparisons looks up.
PROBES = 1 << 20


def hashes(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their distinct shingle hashes and where each row's begin."""
    for lo, hi, data, offsets in tx.slices(column, 1 << 19):
        yield lo, hi, *simhash.distinct(*simhash.rolling_hashes(tx.words_of(tx.LOWER[data], offsets), width))


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of runs of 8-byte ``values``; run i ends before ends[i + 1]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) that are in three or more documents of a sample, and in how many."""
    one_in = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _ in hashes(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["gram"])

    sample = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)).select("text")
    found = sample.mapInArrow(run, "gram long").groupBy("gram").count().where("count > 2").orderBy(F.col("count").desc(), "gram").limit(COMMON).toArrow()
    gram, n = found.column("gram").to_numpy().view(U64), found.column("count").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def prefixes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, s0 and s1 (hashes of the set), size, least (its least other hash), prefix (8 bytes a shingle) and the fingerprint of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, often = shared.value
        for batch in batches:
            for lo, hi, h, first in hashes(batch.column("text"), width):
                rows, size = hi - lo, np.diff(first)
                s0, s1 = simhash.set_hashes(h, first)
                doc = np.repeat(np.arange(rows), size)
                rank = np.zeros(len(h), np.int64)
                if len(gram) and len(h):
                    at = np.minimum(np.searchsorted(gram, h), len(gram) - 1)
                    rank = np.where(gram[at] == h, often[at], 0)
                ordered = h[np.lexsort((h, rank, doc))]
                keep = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
                taken = np.arange(len(h)) - first[doc] < keep[doc]
                prefix = binaries(ordered[taken].astype("<u8"), np.concatenate([[0], np.cumsum(keep)]))
                least = np.full(rows, 2**64 - 1, U64)
                np.minimum.at(least, doc, tx.mix(h ^ U64(0xD6E8FEB86659FD93)))
                prints = simhash.majority(simhash.widened(h, BITS), first)
                columns = [batch.column("doc_id")[lo:hi].cast(pa.int64()), *(pa.array(x.view(np.int64)) for x in (s0, s1)), pa.array(size.astype(np.int32)), pa.array(least.view(np.int64)), prefix, *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s0", "s1", "size", "least", "prefix", *PRINT])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s0 long, s1 long, size int, least long, prefix binary, " + ", ".join(f"{k} long" for k in PRINT))


def meetings(nodes: DataFrame, total: int) -> DataFrame:
    """bucket, gram, node, size, place and two neighbours at this shingle (by least hash and by fingerprint) of nodes at each shingle that two or more have in their prefixes, which hold ``total`` at most."""
    buckets = max(1, -(-total // BUCKET_ROWS))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("prefix").to_pylist()
            n = np.array([len(x) // 8 for x in raw])
            gram = np.frombuffer(b"".join(raw), "<u8")
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
            columns = [(tx.mix(gram) % U64(buckets)).astype(np.int32), gram.view(np.int64), *(batch.column(c).to_numpy()[row] for c in ("node", "size", "least", "f0")), place.astype(np.int32)]
            for i in range(0, len(gram), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65_536]) for c in columns], ["bucket", "gram", "node", "size", "least", "f0", "place"])

    def meet(table: pa.Table) -> pa.Table:
        bucket, gram, node, size, least, place, f0 = (table.column(c).to_numpy() for c in ("bucket", "gram", "node", "size", "least", "place", "f0"))
        found = {}
        for name, order in (("near", np.lexsort((node, f0.view(U64), gram))), ("before", np.lexsort((node, size, least, gram)))):
            g, n = gram[order], node[order]
            other = np.roll(n, 1)
            found[name] = np.empty(len(n), np.int64), np.empty(len(n), bool)
            found[name][0][order], found[name][1][order] = other, (np.roll(g, 1) != g) | (other == n)
        same = g[1:] == g[:-1]
        kept = order[np.append(same, False) | np.insert(same, 0, False)] if len(g) else order
        neighbours = {k: pa.array(x[kept], mask=gone[kept]) for k, (x, gone) in found.items()}
        return pa.table({"bucket": bucket[kept], "gram": gram[kept], "node": node[kept], "size": size[kept], "place": place[kept], **neighbours})

    rows = nodes.select("node", "size", "least", "f0", "prefix").mapInArrow(explode, "bucket int, gram long, node long, size int, least long, f0 long, place int")
    return rows.groupBy("bucket").applyInArrow(meet, "bucket int, gram long, node long, size int, place int, near long, before long")


def starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values that has two or more."""
    cut = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    return begin[end - begin > 1], end[end - begin > 1]


def candidates(met: DataFrame, similarity: float) -> DataFrame:
    """u and v of a spanning forest of the candidates of each task: nodes of ``met`` that meet, differ in component and whose places, sizes and fingerprints allow the similarity."""

    def run(table: pa.Table) -> pa.Table:
        gram, node, component, size, place, block = (table.column(c).to_numpy() for c in ("gram", "node", "component", "size", "place", "block"))
        prints = np.stack([table.column(k).to_numpy().view(U64) for k in PRINT], axis=1)
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        order = np.lexsort((*prints.T[::-1], gram))
        gram, node, component, block, prints = gram[order], node[order], component[order], block[order], prints[order]
        size, place = size[order].astype(np.int64), place[order].astype(np.int64)
        names, at = np.unique(node, return_inverse=True)
        forest = simhash.Forest(len(names))
        for i, j in simhash.trie_pairs(prints, None, BITS, BUDGET, roots=starts(gram)):
            a, b = size[i], size[j]
            # Where the shingle is the first that they share, they share at most it and what follows it.
            share = 1 + np.minimum(a - place[i] - 1, b - place[j] - 1)
            ok = (component[i] != component[j]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (share >= (a + b) * similarity / (1 + similarity) - 1e-9)
            if across:
                ok &= block[i] != block[j]
            forest.add(at[i[ok]], at[j[ok]])
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"u": names[found[:, 0]], "v": names[found[:, 1]]})

    dealt = blocks_of_hot_keys(met, "gram", F.lit(1), BLOCK_ROWS, "bucket", "node")
    return dealt.groupBy("part", "low", "high").applyInArrow(run, "u long, v long").distinct()


class Sets:
    """Shingle sets, each of distinct hashes in order."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(x) // 8 for x in raw], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.frombuffer(b"".join(raw), "<u8")
        grams, self.number = np.unique(flat, return_inverse=True)
        self.many = max(1, len(grams))
        self.keys = np.repeat(np.arange(len(raw)), self.size) * self.many + self.number
        self.keys.sort()

    def similar(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the sets i and j have the similarity, by looking the smaller one's shingles up in the other."""
        small, large = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        n = self.size[small]
        pair = np.repeat(np.arange(len(i)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wanted = large[pair] * self.many + self.number[self.first[small][pair] + k]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        shared = np.bincount(pair[self.keys[at] == wanted], minlength=len(i))
        return shared >= similarity * (self.size[i] + self.size[j] - shared)


def cell_links(cells: DataFrame, similarity: float) -> DataFrame:
    """u and v of a spanning forest of the similar pairs of each task's cells (cell, node, component, size, grams and fingerprint); pairs of one component are left out."""

    def run(table: pa.Table) -> pa.Table:
        cell, node, component, size, block = (table.column(c).to_numpy() for c in ("cell", "node", "component", "size", "block"))
        prints = np.stack([table.column(k).to_numpy().view(U64) for k in PRINT], axis=1)
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        order = np.lexsort((*prints.T[::-1], cell))
        cell, node, block, prints, size = cell[order], node[order], block[order], prints[order], size[order].astype(np.int64)
        sets = Sets(table.column("grams").take(pa.array(order)).to_pylist())
        forest = simhash.Forest(len(node))
        _, first, same = np.unique(component[order], return_index=True, return_inverse=True)
        forest.root = first[same]
        below = -1
        for most in STEPS:
            for i, j in simhash.trie_pairs(prints, None, BITS, most, roots=starts(cell)):
                a, b = size[i], size[j]
                ok = (forest.root[i] != forest.root[j]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
                if across:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
                nearest = np.argsort(apart, kind="stable")
                nearest = nearest[apart[nearest] > below]
                i, j = i[nearest], j[nearest]
                while len(i):
                    few = max(1, int(np.searchsorted(np.cumsum(np.minimum(size[i], size[j])), PROBES)))
                    good = sets.similar(i[:few], j[:few], similarity)
                    forest.add(i[:few][good], j[:few][good])
                    i, j = i[few:], j[few:]
                    left = forest.root[i] != forest.root[j]
                    i, j = i[left], j[left]
            below = most
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"u": node[found[:, 0]], "v": node[found[:, 1]]})

    bytes_of = F.col("size").cast("long") * 8 + 64
    total = cells.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // BLOCK_BYTES))
    dealt = blocks_of_hot_keys(cells.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int")), "cell", bytes_of, BLOCK_BYTES, "bucket", "node")
    return dealt.groupBy("part", "low", "high").applyInArrow(run, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node (the doc_id) and grams (its distinct shingle hashes, 8 bytes each) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, first in hashes(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi].cast(pa.int64()), binaries(h.astype("<u8"), first)], ["node", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, grams binary")


def checked(tried: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``tried`` (u, v; a few for each node) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                good = Sets(batch.column("a").to_pylist() + batch.column("b").to_pylist()).similar(np.arange(n), np.arange(n) + n, similarity)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("u", "v")], ["u", "v"])

    both = tried.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v")
    return both.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, f0 and f1 (hashes of the shingle set) and component_id (the smallest doc_id reachable over similar pairs) of every document."""
    rows = materialize(prefixes(docs, width, similarity))
    sets = materialize(rows.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    of_sets = sets.select("s0", "s1", F.col("node").alias("doc_id"))
    one_each = lambda *columns: rows.select("doc_id", "s0", "s1", *columns).join(of_sets, ["s0", "s1", "doc_id"], "left_semi").dropDuplicates(["s0", "s1", "doc_id"]).withColumnRenamed("doc_id", "node")
    prints = materialize(one_each("size", *PRINT).drop("s0", "s1"))
    met = materialize(meetings(one_each("size", "least", "f0", "prefix"), rows.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8))
    chosen = [met.where(f"{c} is not null").groupBy("node", c).count().groupBy("node").agg(F.max(F.struct("count", c)).alias("best")).select(F.col("node").alias("u"), F.col(f"best.{c}").alias("v")) for c in ("near", "before")]
    tried = chosen[0].unionAll(chosen[1]).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    side = lambda c: prints.select(F.col("node").alias(c), F.struct("size", *PRINT).alias(f"of_{c}"))
    apart = sum((F.bit_count(F.col(f"of_u.{k}").bitwiseXOR(F.col(f"of_v.{k}"))) for k in PRINT), F.lit(0))
    sizes = F.least("of_u.size", "of_v.size") >= similarity * F.greatest("of_u.size", "of_v.size") - 1e-9
    tried = materialize(tried.join(side("u"), "u").join(side("v"), "v").where((apart <= BUDGET) & sizes).select("u", "v"))
    sets_of = lambda nodes: shingle_sets(docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), width)
    grams = materialize(sets_of(tried.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    alike = materialize(checked(tried, grams, similarity))
    known = components(alike)
    met = met.select("bucket", "gram", "node", "size", "place").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = met.groupBy("gram").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("gram")
    still = materialize(met.join(apart, "gram", "left_semi"))
    cells = components(candidates(still.join(prints.drop("size"), "node"), similarity)).withColumnRenamed("component", "cell")
    cells = cells.join(still.select("node", "component").distinct(), "node").join(prints, "node")
    cells = materialize(cells.join(materialize(sets_of(cells.select("node"))), "node"))
    found = components(alike.unionAll(cell_links(cells, similarity)))
    sets = materialize(sets.join(found, "node", "left").select("s0", "s1", "rows", F.coalesce("component", "node").alias("component_id")))
    return joined_back(rows.select("doc_id", "s0", "s1"), sets, ["s0", "s1"]).select("doc_id", F.col("s0").alias("f0"), F.col("s1").alias("f1"), "component_id")

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, searched by multi-index Hamming blocks.

Each benchmark item has a 128-bit SimHash over its words. A document's windows of an item's size get theirs from
running sums. Fingerprints are cut into BLOCKS blocks of 16 bits. Two that are at most RADIUS bits apart are at most
NEAR = RADIUS // BLOCKS bits apart in some block, so an index of all values within ITEM_TURNS bits of an item's block,
looked up with all values within NEAR - ITEM_TURNS bits of a window's block, finds every such pair; in a block one pair in
a hundred comes up by chance. Candidates within the radius are then verified by the weighted Jaccard similarity of window
and item on n-word shingles: an item's shingle weighs log(1 + items / items that hold it), any other log(1 + items).

A window can only be similar if it holds a shingle of an item, so windows without one are passed over unseen; this
loses nothing. Benchmarks larger than ITEMS are searched in parts, since a part's index is broadcast; the weights are
counted over the whole benchmark first, so parts don't change a result.

Words are lower-cased (A-Z). Defined cases: null or blank texts and items match nothing; an item of fewer than n words
is one shingle and matches where its words stand; a document shorter than an item is one window; repeated ids of
documents or items give a row for each match with the best similarity; of equally similar windows one is named; texts of
any length are searched whole; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.runtime import Scratch, documents, prepare, trimmed

#: Bits that may differ, blocks of 16 bits, and bits turned on the items' side; items searched at a time (their index is
#: what is broadcast). One word changed in an item of 14 turns 15 bits at the mean, 4 standard deviations below the radius.
RADIUS, BLOCKS, ITEM_TURNS, ITEMS = 31, 8, 2, 20_000
NEAR = RADIUS // BLOCKS
OUT_SQL = "doc_id long, item_id long, similarity double, distance int, start int, n_words int"


def turns(bits: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= bits].astype(np.uint16)


def lanes(words: np.ndarray) -> np.ndarray:
    """128 signs for each word."""
    both = np.stack([W.mix(words, 21), W.mix(words, 22)], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(words), 16), axis=1).astype(np.int8) * 2 - 1


def prints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints of some windows, 16 bytes each."""
    if len(starts) == 0:
        return np.zeros((0, 16), np.uint8)
    lo, hi = int(starts.min()), int(starts.max()) + size
    sums = np.zeros((hi - lo + 1, 128), np.int32)
    np.cumsum(lanes(words[lo:hi]), axis=0, out=sums[1:])
    return np.packbits(sums[starts - lo + size] - sums[starts - lo] > 0, axis=1)


class Index:
    """What is broadcast of some items: ids and texts, with ``owners``, the items of the whole benchmark that hold a shingle, and their number ``total``."""

    def __init__(self, ids: list, texts: pa.Array, n: int, owners: dict[int, int], total: int):
        self.n, self.items = n, []
        grams: dict[int, set[int]] = {}
        for k, words in W.per_row(texts, True):
            if len(words) and ids[k] is not None:
                g = W.grams(words, min(n, len(words)))
                number = len(self.items)
                self.items.append((ids[k], words, g))
                for x in np.unique(g).tolist():
                    grams.setdefault(x, set()).add(number)
        self.grams = np.array(sorted(grams), W.U)
        self.owners = [sorted(grams[x]) for x in self.grams.tolist()]
        self.weight = np.array([math.log1p(total / owners[x]) for x in self.grams.tolist()])
        self.unseen = math.log1p(total)
        self.sizes = sorted({min(n, len(w)) for _, w, _ in self.items})
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.grams >> W.U(44)] = True
        self.tables: dict[int, tuple] = {}
        for size in {len(w) for _, w, _ in self.items}:
            members = np.array([k for k, (_, w, _) in enumerate(self.items) if len(w) == size])
            self.tables[size] = (members, np.concatenate([prints(self.items[k][1], np.zeros(1, np.int64), size) for k in members]))
        self.blocks: dict[int, list] = {}

    def __getstate__(self):
        return self.__dict__ | {"blocks": {}}  # made where they are needed

    def seen(self, g: np.ndarray) -> np.ndarray:
        """Positions of items' shingles."""
        at = np.flatnonzero(self.bitmap[g >> W.U(44)])
        where = np.searchsorted(self.grams, g[at])
        return at[self.grams[np.minimum(where, len(self.grams) - 1)] == g[at]]

    def block_tables(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the sorted values within ITEM_TURNS bits of an item's, and the items."""
        if size not in self.blocks:
            parts, masks = self.tables[size][1].view(np.uint16), turns(ITEM_TURNS)
            made = []
            for j in range(BLOCKS):
                values = (parts[:, j, None] ^ masks).reshape(-1)
                order = np.argsort(values, kind="stable")
                made.append((values[order], (order // len(masks)).astype(np.int32)))
            self.blocks[size] = made
        return self.blocks[size]

    def near(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        members, mine = self.tables[size]
        pairs, parts, masks = [np.zeros(0, np.int64)], np.ascontiguousarray(codes).view(np.uint16), turns(NEAR - ITEM_TURNS)
        for j, (values, owner) in enumerate(self.block_tables(size)):
            probes = (parts[:, j, None] ^ masks).reshape(-1)
            lo, hi = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(probes)) // len(masks), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            pairs.append(np.unique(window * len(members) + owner[inner]))
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(members), pair % len(members)
        distance = np.bitwise_count(codes[window] ^ mine[item]).sum(axis=1)
        ok = distance <= RADIUS
        return window[ok], members[item[ok]], distance[ok]

    def weights(self, own: np.ndarray) -> np.ndarray:
        """The weights of an item's shingles."""
        return self.weight[np.searchsorted(self.grams, own)]


def similarity(a: np.ndarray, b: np.ndarray, weight: np.ndarray, unseen: float) -> float:
    """Weighted Jaccard of a window's and an item's multisets of shingles; ``weight`` is that of the item's."""
    x, nx = np.unique(a, return_counts=True)
    y, iy, ny = np.unique(b, return_index=True, return_counts=True)
    _, px, py = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    wy = weight[iy]
    common = (np.minimum(nx[px], ny[py]) * wy[py]).sum()
    window = (nx[px] * wy[py]).sum() + unseen * (nx.sum() - nx[px].sum())
    return float(common / max(window + (ny * wy).sum() - common, 1e-12))


def search(words: np.ndarray, hits: dict[int, np.ndarray], index: Index, threshold: float) -> dict[int, tuple]:
    """The best window of each item that a document holds: item -> (similarity, distance, start, size)."""
    best: dict[int, tuple] = {}
    for k, at in hits.items():
        g = W.grams(words, k)
        owned = [index.owners[x] for x in np.searchsorted(index.grams, g[at]).tolist()]
        sizes: dict[int, list[int]] = {}
        for p, own in zip(at.tolist(), owned, strict=True):
            for size in {len(index.items[i][1]) for i in own}:
                if min(index.n, size) == k:
                    sizes.setdefault(size, []).append(p)
        for size, where in sizes.items():
            span = min(size, len(words))
            p = np.array(where)
            starts = np.unique(np.clip(p[:, None] - np.arange(span - k + 1), 0, len(words) - span))
            for part in np.array_split(starts, max(1, len(starts) // 4096)):
                windows, items, distances = index.near(prints(words, part, span), size)
                for item in np.unique(items).tolist():
                    mine = items == item
                    begin, apart = part[windows[mine]], distances[mine]
                    own, m = index.items[item][2], span - k + 1
                    weight = index.weights(own)
                    order = np.argsort(own, kind="stable")
                    held = np.minimum(np.searchsorted(own[order], g), len(own) - 1)
                    inside = own[order][held] == g
                    worth = np.where(inside, weight[order][held], index.unseen)
                    sums, all_ = np.concatenate([[0], np.cumsum(worth * inside)]), np.concatenate([[0], np.cumsum(worth)])
                    common = np.minimum(sums[begin + m] - sums[begin], weight.sum())
                    most = common / np.maximum(all_[begin + m] - all_[begin] + weight.sum() - common, 1e-12)
                    for o in np.argsort(-most, kind="stable").tolist():
                        known = best.get(item, (0.0,))[0]
                        if most[o] < threshold - 1e-9 or most[o] <= known:
                            break
                        s = int(begin[o])
                        found = similarity(g[s : s + m], own, weight, index.unseen)
                        if found >= threshold - 1e-9 and found > known:
                            best[item] = (min(found, 1.0), int(apart[o]), s, span)
    return best


def searcher(shared, threshold: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            data, at = W.utf8(batch.column(1))
            for i, j in W.chunks(at):
                hashes, first = W.word_hashes(data, at[i : j + 1], True)
                found: dict[int, dict[int, np.ndarray]] = {}
                for k in index.sizes:
                    seen = index.seen(W.grams(hashes, k))
                    row = np.searchsorted(first, seen, "right") - 1
                    inside = seen + k <= first[row + 1]
                    seen, row = seen[inside], row[inside]
                    for r in np.unique(row).tolist():
                        found.setdefault(r, {})[k] = seen[row == r] - first[r]
                for r, hits in found.items():
                    for item, (s, d, start, size) in search(hashes[first[r] : first[r + 1]], hits, index, threshold).items():
                        rows.append((ids[i + r], index.items[item][0], s, d, start, size))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "distance", "start", "n_words"])

    return run


def shingles(n: int):
    """(item_id, text) -> the distinct shingles of each item that has any words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            found = [np.unique(W.grams(words, min(n, len(words)))) if len(words) and ids[k].is_valid else np.zeros(0, W.U) for k, words in W.per_row(batch.column(1), True)]
            yield pa.RecordBatch.from_arrays([W.lists([W.signed(f) for f in found])], names=["grams"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, at_a_time: int = ITEMS) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> a row for each item that a document holds.

    ``doc_id, item_id, similarity, distance, start, n_words``: the best window, in words, and the bits that its
    fingerprint is away from the item's.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    docs, items = documents(docs, "doc_id", "text"), documents(benchmark, "item_id", "text")
    parts = max(1, -(-items.count() // at_a_time))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    held = items.select("item_id", "text").mapInArrow(shingles(n), "grams array<long>").filter("size(grams) > 0")
    total = held.count()
    owners = scratch.save(held.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("owners")), "owners")
    out = None
    for part in range(parts):
        block = items.filter(F.col("part") == part).select("item_id", "text")
        own = block.mapInArrow(shingles(n), "grams array<long>").select(F.explode("grams").alias("gram")).distinct()
        counted = owners.join(own, "gram", "left_semi").toArrow()  # as many as the part's items have
        known = dict(zip(counted.column("gram").to_numpy().view(np.uint64).tolist(), counted.column("owners").to_pylist(), strict=True))
        rows = block.toArrow()
        index = Index(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks(), n, known, total)
        if not index.items:
            continue
        found = docs.mapInArrow(trimmed(searcher(spark.sparkContext.broadcast(index), threshold)), OUT_SQL)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], OUT_SQL) if out is None else out

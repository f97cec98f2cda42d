"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``window`` consecutive words of a document. Words are removed that a window covers whose word sequence also
starts in a document with a smaller id. Documents are parsed against reference blocks of earlier documents:

1. Anchors. Every window names one anchor, its least k-gram (k = window / 2); equal windows name equal anchors. The
   index keeps, for each anchor that two documents share, one occurrence in the smallest of them: the middle one, which
   in repetitive text has the repetition on both sides.
2. Reference blocks. Only the blocks of a document that hold indexed occurrences are cut out, with their context, and
   each document is sent the blocks that it shares anchors with, once each and as rows of their own.
3. Factors. From each anchor the match with the block is extended both ways to the first word that differs or the block's
   end. A document is then parsed greedily from left to right: of the matches that begin where the parse stands or
   before, the one that reaches furthest is the next factor. Blocks overlap by a window, so a longer match goes on in the
   next block's factor. The windows of a factor of at least ``window`` words are duplicates.
4. Factor boundaries. A window with a shared anchor that no factor covers, as it crosses a factor's end, may still
   occur in another document than the indexed one. These windows alone are grouped by hash with their smallest id.

Equal word sequences fall together before step 1, so groups of copies cost one group-by. The result is exact but for
64-bit hash collisions; no group is capped, and no group's pairs are formed.

Defined cases: a null text has no words; windows are judged on the input; rows with one and the same id don't remove
each other's words; rows with a null id neither remove nor lose words; very long texts are parsed whole; of equal anchors
in a window the first counts; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.runtime import Scratch, documents, prepare, small

#: Words of a reference block without its context.
BLOCK = 256
SKETCH_SQL = "doc_id long, f1 long, f2 long, n_words long, anchors array<long>, at array<int>"
FACTOR_SQL = "doc_id long, f1 long, runs array<int>, hashes array<long>, starts array<int>"
OUT_SQL = "doc_id long, n_words long, n_removed long, kept string, spans array<int>"


def fingerprints(words: np.ndarray) -> tuple[int, int]:
    if len(words) == 0:
        return 0, 0
    both = [int(W.mix(W.grams(W.mix(words, k), len(words)), k)[0]) for k in (5, 6)]
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in both)  # type: ignore[return-value]


def minimizers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor position, and the hashes of all k-grams."""
    k = window // 2
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, W.U)
    g = W.grams(words, k)
    view = np.lib.stride_tricks.sliding_window_view(g, window - k + 1)
    out = np.empty(len(view), np.int64)
    for i in range(0, len(view), 1 << 16):
        out[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(axis=1)
    return out + np.arange(len(view)), g


def sketches(window: int):
    def run(batches):
        for batch in batches:
            f1, f2, n, anchors, at = [], [], [], [], []
            for _, words in W.per_row(batch.column(1), False):
                a, b = fingerprints(words)
                where, g = minimizers(words, window)
                where = where[np.flatnonzero(np.diff(where, prepend=-1))]
                f1.append(a), f2.append(b), n.append(len(words))
                anchors.append(W.signed(g[where])), at.append(where.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), W.lists(anchors), W.lists(at, np.int32)],
                names=["doc_id", "f1", "f2", "n_words", "anchors", "at"],
            )

    return run


def blocks(window: int):
    """(doc_id, text, wanted: [f1, block numbers]) -> (hub, hub_f1, block, words): words from window/2 before the block to window after it."""
    before, after = window - window // 2, window

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            data, at = W.utf8(batch.column(1))
            wanted = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for i, j in W.chunks(at):
                starts, ends, first = W.word_spans(data, at[i : j + 1])
                hashes, _ = W.word_hashes(data, at[i : j + 1], False)
                part = data[at[i] : at[j]]
                for k in range(i, j):
                    lo, hi = first[k - i], first[k - i + 1]
                    mine = fingerprints(hashes[lo:hi])[0]
                    for block in {b for x in wanted[k] if x["f1"] == mine for b in x["blocks"]}:
                        p, q = max(lo, lo + block * BLOCK - before), min(hi, lo + (block + 1) * BLOCK + after)
                        out.append((ids[k], mine, block, part[starts[p] : ends[q - 1]].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["hub", "hub_f1", "block", "words"])

    return run


def matches(x: np.ndarray, p: np.ndarray, ref: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest matches [from, to) of x with ref around the k-grams at p and q; empty where these differ."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(ref))
    for i in range(0, len(p), 2048):
        pp, qq = p[i : i + 2048, None], q[i : i + 2048, None]
        there = pp - qq + at
        apart = (there < 0) | (there >= len(x)) | (x[np.clip(there, 0, len(x) - 1)] != ref)
        left = np.where(apart & (at < qq), at, -1).max(axis=1) + 1
        right = np.where(apart & (at >= qq), at, len(ref)).min(axis=1)
        shift = (pp - qq)[:, 0]
        whole = right >= qq[:, 0] + k
        starts.append((left + shift)[whole]), ends.append((right + shift)[whole])
    return np.concatenate(starts), np.concatenate(ends)


def parse(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse of some matches: from left to right, always the one that reaches furthest."""
    order = np.lexsort((-ends, starts))
    starts, ends = starts[order], ends[order]
    before = np.maximum.accumulate(np.concatenate([[-1], ends]))[:-1]
    return starts[ends > before], ends[ends > before]


class Parsing:
    """The parse of one document, as the blocks that it shares anchors with come in one by one."""

    def __init__(self, raw: bytes, window: int):
        self.words, _ = W.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), False)
        self.window, self.k, self.name = window, window // 2, fingerprints(self.words)[0]
        self.anchor, _ = minimizers(self.words, window)
        self.open = np.zeros(len(self.anchor), bool)  # windows with a shared anchor
        self.starts, self.ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, block: int, raw: bytes | None, p: np.ndarray, q: np.ndarray) -> None:
        for a, b in zip(np.searchsorted(self.anchor, p, "left"), np.searchsorted(self.anchor, p, "right"), strict=True):
            self.open[a:b] = True
        if raw is None:  # further occurrences within the indexed document itself
            return
        ref, _ = W.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), False)
        base = max(0, block * BLOCK - (self.window - self.k))
        begin, end = matches(self.words, p, ref, q - base, self.k)
        self.starts.append(begin[end - begin >= self.window]), self.ends.append(end[end - begin >= self.window])

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Duplicate windows as runs [from, to), and the hashes and starts of windows that cross factor boundaries."""
        dup = np.zeros(len(self.anchor), bool)
        for a, b in zip(*parse(np.concatenate(self.starts), np.concatenate(self.ends)), strict=True):
            dup[a : b - self.window + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], dup.view(np.int8), [0]])))
        rest = np.flatnonzero(self.open & ~dup)
        hashes = W.grams(self.words, self.window)[rest] if len(rest) else np.zeros(0, W.U)
        return edges.astype(np.int32), hashes, rest.astype(np.int32)


#: What stands for a block's number in the rows of documents themselves.
TEXT = -2


def factors(window: int):
    """(doc_id, f1, block, words, p, q), each document's text before its blocks -> its factors; one document is held at a time."""

    def batch(done: list[tuple[int, Parsing]]) -> pa.RecordBatch:
        found = [x.factors() for _, x in done]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in done], pa.int64()), pa.array([x.name for _, x in done], pa.int64()), W.lists([f[0] for f in found], np.int32), W.lists([W.signed(f[1]) for f in found]), W.lists([f[2] for f in found], np.int32)],
            names=["doc_id", "f1", "runs", "hashes", "starts"],
        )

    def run(batches):
        mine: list[tuple[int, Parsing]] = []
        for rows in batches:
            ids, names, numbers = (rows.column(k).to_pylist() for k in range(3))
            for k, (doc, f1, block) in enumerate(zip(ids, names, numbers, strict=True)):
                if mine and mine[0][0] != doc:
                    yield batch(mine)
                    mine = []
                raw = rows.column(3)[k].as_py()
                if block == TEXT:
                    mine.append((doc, Parsing(raw or b"", window)))
                    continue
                p, q = (rows.column(c)[k].values.to_numpy().astype(np.int64) for c in (4, 5))
                for _, x in mine:
                    if x.name == f1:
                        x.add(block, raw, p, q)
        if mine:
            yield batch(mine)

    return run


def cut(window: int):
    """(doc_id, text, all: [f1], found: [f1, runs, starts]) -> the kept text."""

    def run(batches):
        for batch in batches:
            data, at = W.utf8(batch.column(1))
            whole, found, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).cast(pa.int64())
            n_words, n_removed, kept, spans = [], [], [], []
            for i, j in W.chunks(at):
                for k in range(i, j):
                    words = data[at[k] : at[k + 1]].tobytes().split()
                    n = len(words)
                    gone = np.zeros(n + 1, np.int32)
                    if whole[k] or found[k]:
                        hashes, _ = W.word_hashes(data, at[k : k + 2], False)
                        mine = fingerprints(hashes)[0]
                        if mine in (whole[k] or ()):
                            gone[0] += 1
                            gone[n] -= 1
                        for x in found[k] or ():
                            if x["f1"] == mine:
                                runs = np.array(x["runs"], np.int64).reshape(-1, 2)
                                np.add.at(gone, runs[:, 0], 1)
                                np.add.at(gone, runs[:, 1] - 1 + window, -1)
                                s = np.array(x["starts"], np.int64)
                                np.add.at(gone, s, 1)
                                np.add.at(gone, s + window, -1)
                        lost = np.cumsum(gone)[:n] > 0
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
                        words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                    else:
                        edges = np.zeros(0, np.int64)
                    n_words.append(n), n_removed.append(n - len(words)), kept.append(b" ".join(words)), spans.append(edges)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), W.lists(spans, np.int32)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_words, n_removed, kept, spans``, one row per document.

    ``kept`` is the text without the removed words, joined by one space; ``spans`` lists the removed word ranges
    [from, to) as pairs.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    save = scratch.save
    docs = documents(docs, "doc_id", "text")
    sketch = save(docs.mapInArrow(sketches(window), SKETCH_SQL), "sketch")
    long = sketch.filter(f"n_words >= {window} and doc_id is not null")
    equal = save(long.groupBy("f1", "f2", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "equal")
    copies = save(
        long.select("doc_id", "f1", "f2", "n_words").join(equal, ["f1", "f2", "n_words"]).filter("doc_id > first").select("doc_id", "f1").distinct(),
        "copies",
    )
    apart = long.join(small(copies), ["doc_id", "f1"], "left_anti")
    seen = apart.select("doc_id", "f1", F.explode(F.arrays_zip("anchors", "at")).alias("x")).select("doc_id", "f1", F.col("x.anchors").alias("h"), F.col("x.at").alias("p"))
    index = seen.groupBy("h").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").drop("last")
    # saved first, so that the join shuffles both sides anew and a common anchor is split
    shared = save(seen.join(save(index, "index"), "h"), "shared")
    held = shared.filter("doc_id = hub").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("p", "f1"))).alias("x"))
    first = held.withColumn("x", F.element_at("x", F.floor(F.size("x") / 2).cast("int") + 1)).select("h", F.col("x.p").alias("q"), F.col("x.f1").alias("hub_f1"))
    located = shared.join(save(first, "first"), "h").filter("not (doc_id = hub and p = q and f1 = hub_f1)")
    own = F.col("doc_id") == F.col("hub")
    pairs = save(
        located.withColumn("block", F.when(own, F.lit(-1)).otherwise(F.floor(F.col("q") / BLOCK)).cast("int"))
        .groupBy("doc_id", "f1", "hub", "hub_f1", "block").agg(F.collect_list(F.struct("p", "q")).alias("x"))
        .select("doc_id", "f1", "hub", "hub_f1", "block", F.col("x.p").alias("p"), F.col("x.q").alias("q")),
        "pairs",
    )
    wanted = save(
        pairs.filter("block >= 0").groupBy("hub", "hub_f1").agg(F.collect_set("block").alias("blocks"))
        .groupBy(F.col("hub").alias("doc_id")).agg(F.collect_list(F.struct(F.col("hub_f1").alias("f1"), "blocks")).alias("wanted")),
        "wanted",
    )
    index_blocks = save(docs.join(small(wanted), "doc_id").select("doc_id", "text", "wanted").mapInArrow(blocks(window), "hub long, hub_f1 long, block int, words binary").dropDuplicates(["hub", "hub_f1", "block"]), "blocks")
    # a document's text and then, one by one, the blocks that it shares anchors with
    needing = small(save(pairs.select("doc_id").distinct(), "needing"))
    nowhere = F.array().cast("array<int>")
    itself = docs.join(needing, "doc_id", "left_semi").select("doc_id", F.lit(None).cast("long").alias("f1"), F.lit(TEXT).alias("block"), F.col("text").cast("binary").alias("words"), nowhere.alias("p"), nowhere.alias("q"))
    hits = pairs.join(index_blocks, ["hub", "hub_f1", "block"], "left").select("doc_id", "f1", "block", "words", "p", "q")
    rows = itself.unionByName(hits).repartition("doc_id").sortWithinPartitions("doc_id", "block")
    factored = save(rows.mapInArrow(factors(window), FACTOR_SQL).dropDuplicates(["doc_id", "f1"]), "factored")
    crossing = factored.select("doc_id", "f1", F.explode(F.arrays_zip("hashes", "starts")).alias("x")).select("doc_id", "f1", F.col("x.hashes").alias("h"), F.col("x.starts").alias("start"))
    twice = save(crossing.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "twice")
    more = crossing.join(twice, "h").filter("doc_id > first").groupBy("doc_id", "f1").agg(F.collect_list("start").alias("starts"))
    none = F.array().cast("array<int>")
    found = save(
        factored.select("doc_id", "f1", "runs").join(more, ["doc_id", "f1"], "left").filter("size(runs) > 0 or starts is not null")
        .select("doc_id", "f1", "runs", F.coalesce("starts", none).alias("starts"), F.lit(False).alias("all"))
        .unionByName(copies.select("doc_id", "f1", none.alias("runs"), none.alias("starts"), F.lit(True).alias("all")))
        .groupBy("doc_id").agg(F.collect_list(F.when(F.col("all"), F.col("f1"))).alias("whole"), F.collect_list(F.when(~F.col("all"), F.struct("f1", "runs", "starts"))).alias("found")),
        "found",
    )
    scratch.drop("sketch", "shared", "first", "pairs", "blocks", "factored", "twice", "equal")
    weight = found.agg(F.sum(F.expr("8 + size(whole) + aggregate(found, 0L, (s, x) -> s + size(x.runs) + size(x.starts))"))).first()[0] or 0
    side = F.broadcast(found) if weight <= 4_000_000 else found
    return docs.join(side, "doc_id", "left").select("doc_id", "text", "whole", "found").mapInArrow(cut(window), OUT_SQL)

"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, contiguous ranges of the
order, so each document falls into one segment for each fragment. Overlaps are partial, one for each fragment, and
summed for each pair.

Candidates come from the partial overlaps that are full, where two segments are equal: the symmetric difference of two
sets of similarity ``threshold`` has at most ``D`` n-grams, a number that their sizes bound, so with more than ``D``
fragments some partial overlap is full. Of a document's segments only the ``D + 1`` rarest are needed to meet every
partner, so common ones (empty segments, boilerplate) seldom make candidates. The other partial overlaps are counted
for candidates only: for each fragment apart (equal segments count whole, only differing ones are compared), then
summed. To count every n-gram that two documents share would put all pairs of a common n-gram in a row; the bound makes
that needless. Nothing is capped, and the result is exact but for 64-bit hash collisions.

The nodes of the join are distinct sets, named by a hash, so documents with equal sets are one node from the start and
texts are read once for all keys. Groups of any size are handled without all their pairs. Sets that share a segment are
compared with one of them, the hub. Only groups that still hold sets of different components go on: small ones as
pairs across components, large ones by the rarest of finer segments, where enough segments are taken that no similar
pair is missed. Numbers of links need every pair inside a component: its sets are written as differences from one of
them, dealt out in blocks, and two blocks at a time are counted as a matrix; only sums for each set leave a task.

Defined cases: null or blank texts and null ids have no n-grams or no node and link with nothing (component: the own
id); a document with fewer than n words has its whole sequence as its only n-gram; rows that share an id are in one
component, whatever their texts; very long texts are one set like others, and ties between keys are broken by the key;
repeated rows are rows, each linked with the others; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.components import components
from quillspark.llm.runtime import Scratch, documents, prepare, small, trimmed

#: Fragments of the order in which partial overlaps are counted.
FRAGMENTS = 64
#: Sizes of a class differ by at most this factor; each class has its own number of fragments for candidates.
CLASS_GROWTH = 1.5
#: Groups of at most so many sets are paired as they are.
FEW = 16
#: Sets of a block, and differing n-grams in it, where links inside a component are counted.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
#: Sets that a task remembers, so that the keys of equal sets leave it once.
REMEMBERED = 1 << 19
#: Bits (a power of two) of the filter of shared keys that is broadcast: 16 MB, whatever the corpus. Keys that it lets
#: through by chance cost a shuffle only.
FILTER_BITS = 27
#: Bytes of the pieces in which executors pack it.
PIECE_BYTES = 1 << 11


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a document."""
    if len(words) == 0:
        return np.zeros(0, W.U)
    return np.unique(W.grams(words, min(n, len(words))))


def set_name(grams: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    one, two = (np.add.reduce(W.mix(grams, salt)) for salt in (11, 12))
    name = W.mix(np.array([one, two, len(grams)], W.U), 13)
    return int(W.signed(W.mix(name[:1] ^ (name[1:2] << W.U(1)) ^ (name[2:] << W.U(2)), 14))[0])


class Classes:
    """Size classes [edge[c], edge[c+1]) and each one's bound of differing n-grams."""

    def __init__(self, threshold: int):
        self.t = threshold
        self.least = next(n for n in range(1, 10_000) if ceil(threshold * (n + 1) / 100) <= n)  # smaller sets link only when equal
        self.edges = [self.least]

    def most_apart(self, c: int) -> int:
        total = 2 * (self.edge(c + 1) - 1)  # |x| + |y| of two members at most
        return max(s - 2 * (-(-self.t * s // (100 + self.t))) for s in (total, total - 1))

    def edge(self, c: int) -> int:
        while len(self.edges) <= c:
            self.edges.append(int(self.edges[-1] * CLASS_GROWTH) + 1)
        return self.edges[c]

    def of(self, size: int) -> list[int]:
        """The own class, and those above in which a similar larger set can be."""
        c = 0
        while self.edge(c + 1) <= size:
            c += 1
        out = [c]
        while size * 100 // self.t >= self.edge(out[-1] + 1):
            out.append(out[-1] + 1)
        return out


def segment_keys(grams: np.ndarray, c: int, count: int, salt: int) -> np.ndarray:
    """A key for each of a set's segments, empty ones too, in one class."""
    sums = np.zeros(len(grams) + 1, W.U)
    np.cumsum(W.mix(grams, 1), out=sums[1:])
    cuts = fragment_cuts(grams, count)
    keys = W.mix(sums[cuts[1:]] - sums[cuts[:-1]], 2)
    return W.mix(keys ^ (np.arange(count, dtype=W.U) << W.U(20)) ^ (W.U(c) << W.U(50)), salt)


def fragment_cuts(grams: np.ndarray, count: int) -> np.ndarray:
    """Where each of count equal ranges of the order begins in a sorted set (count+1)."""
    edges = (np.arange(1, count, dtype=np.uint64) << W.U(32)) // W.U(count) << W.U(32)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]]).astype(np.int64)


def class_keys(grams: np.ndarray, classes: Classes, fine: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, need, keys) for each size class in which a set can have partners.

    ``need`` is one more than the segments in which a similar pair can differ.
    """
    if len(grams) < classes.least:
        return
    t = classes.t
    for c in classes.of(len(grams)):
        count = 4 * classes.most_apart(c) + 2 if fine else classes.most_apart(c) * 106 // 100 + 3
        most = len(grams) + min(len(grams) * 100 // t, classes.edge(c + 1) - 1)
        yield c, most * (100 - t) // (100 + t) + 1, W.signed(segment_keys(grams, c, count, 5 if fine else 3))


SETS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("digests", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("segments", pa.list_(pa.list_(pa.int64())))])
CLASS_SQL = "array<struct<class:int,need:int,keys:array<long>>>"
PARSED_SQL = f"doc_id long, node long, n_shingles long, classes {CLASS_SQL}"
FINE_SQL = f"node long, n long, classes {CLASS_SQL}"
SETS_SQL = "node long, n long, digests array<long>, counts array<int>, segments array<array<long>>"
GRAMS_SQL = "node long, n long, grams binary"


def class_lists(rows: list[list[tuple[int, int, np.ndarray]]]) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    inner = pa.StructArray.from_arrays([pa.array([c for c, _, _ in flat], pa.int32()), pa.array([n for _, n, _ in flat], pa.int32()), W.lists([k for *_, k in flat])], ["class", "need", "keys"])
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(row) for row in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), inner)


def parsed(n: int, threshold: int):
    """(doc_id, text) -> a row for each: its set's name and size, and, where a task meets a set first, its segments' keys."""

    def run(batches):
        classes, known = Classes(threshold), set()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            sizes, names, keys = [], [], []
            for k, words in W.per_row(batch.column(1), True):
                grams = gram_set(words, n)
                name = set_name(grams)
                first = name not in known and ids[k].is_valid
                if first:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(name)
                sizes.append(len(grams)), names.append(name), keys.append(list(class_keys(grams, classes, False)) if first else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), class_lists(keys)], names=["doc_id", "node", "n_shingles", "classes"])

    return run


KEPT_SQL = "node long, class int, need int, parts int, keys array<long>"


def marked(batches):
    """(place) -> the pieces of the filter that a task's places are in, as bytes."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    met = np.zeros(len(bits) // PIECE_BYTES, bool)
    for batch in batches:
        place = batch.column(0).to_numpy()
        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        met[(place >> 3) // PIECE_BYTES] = True
    at, pieces = np.flatnonzero(met), bits.reshape(-1, PIECE_BYTES)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([pieces[k].tobytes() for k in at.tolist()], pa.binary())], names=["piece", "bits"])


def key_filter(often: DataFrame) -> np.ndarray:
    """One bit for each value of the first FILTER_BITS bits of a key, packed by executors: the driver gets these bits and no more."""
    place = often.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).cast("int").alias("place"))
    packed = place.repartition(F.floor(F.col("place") / (8 * PIECE_BYTES))).mapInArrow(trimmed(marked), "piece int, bits binary").toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8).reshape(-1, PIECE_BYTES)
    for batch in packed.to_batches():
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[k] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1).view(W.U)


def passing(filter_):
    """(node, classes) -> a row for each class with the keys that the filter lets through."""

    def run(batches):
        bits = filter_.value
        for batch in batches:
            each = batch.column(1)
            classes = each.flatten()
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(each.offsets.to_numpy()))
            keys = classes.field("keys")
            at = keys.offsets.to_numpy()
            flat = keys.values.to_numpy()[at[0] : at[-1]]
            place = flat.view(W.U) >> W.U(64 - FILTER_BITS)
            keep = (bits[place >> W.U(6)] >> (place & W.U(63)) & W.U(1)).astype(bool)
            ends = np.concatenate([[0], np.cumsum(keep)])[at - at[0]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), classes.field("class"), classes.field("need"), pa.array(np.diff(at).astype(np.int32)), lists], names=["node", "class", "need", "parts", "keys"])

    return run


def fine_keys(n: int, threshold: int):
    def run(batches):
        classes = Classes(threshold)
        for batch in batches:
            names, sizes, keys = [], [], []
            for _, words in W.per_row(batch.column(1), True):
                grams = gram_set(words, n)
                names.append(set_name(grams)), sizes.append(len(grams)), keys.append(list(class_keys(grams, classes, True)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), class_lists(keys)], names=["node", "n", "classes"])

    return run


def segment_sets(n: int):
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 100):  # whole sets are large: few rows at a time
                part = batch.slice(start, 100)
                names, sizes, digests, counts, flat, ends = [], [], [], [], [], [0]
                for _, words in W.per_row(part.column(1), True):
                    grams = gram_set(words, n)
                    cuts = fragment_cuts(grams, FRAGMENTS)
                    sums = np.zeros(len(grams) + 1, W.U)
                    np.cumsum(W.mix(grams, 1), out=sums[1:])
                    names.append(set_name(grams)), sizes.append(len(grams))
                    digests.append(W.signed(sums[cuts[1:]] - sums[cuts[:-1]]))
                    counts.append(np.diff(cuts).astype(np.int32))
                    ends.extend(ends[-1] + cuts[1:])
                    flat.append(W.signed(grams))
                inner = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * FRAGMENTS), inner)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), W.lists(digests), W.lists(counts, np.int32), outer], schema=SETS)

    return run


def gram_sets(n: int):
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 100):
                part = batch.slice(start, 100)
                sets = [gram_set(words, n) for _, words in W.per_row(part.column(1), True)]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["node", "n", "grams"])

    return run


def differences(batches):
    """(label, node, n, held, grams, base) -> what a set and the one that names its component don't share, and how many of the latter's n-grams it lacks."""
    for batch in batches:
        lost, apart = [], []
        for mine, base in zip(batch.column(4), batch.column(5), strict=True):
            x, y = (np.frombuffer(b.as_buffer(), W.U) for b in (mine, base))
            gone = np.setdiff1d(y, x, assume_unique=True)
            lost.append(len(gone)), apart.append(W.signed(np.concatenate([gone, np.setdiff1d(x, y, assume_unique=True)])))
        base_n = pa.array([len(b.as_buffer()) // 8 for b in batch.column(5)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], base_n, pa.array(lost, pa.int64()), W.lists(apart)], names=["label", "node", "n", "held", "base_n", "lost", "apart"])


def shared_counts(rows: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members each of the left lists has in common with each of the right ones."""
    lengths = np.diff(rows.offsets.to_numpy())
    grams = rows.values.to_numpy()[rows.offsets[0].as_py() : rows.offsets[-1].as_py()]
    owner = np.repeat(np.arange(len(rows)), lengths)
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    keep = times[at] > 1  # what one list alone holds is shared by none
    owner, at = owner[keep], np.unique(at[keep], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [start, start + width])
        held = np.zeros((len(rows), width), np.float32)
        held[owner[a:b], at[a:b] - start] = 1
        out += held[left] @ held[right].T
    return out


def block_links(threshold: int):
    """Two blocks of a component (or one and itself) -> for each set, how many rows of the other block link with it."""

    def run(key, table):
        x, y = key[1].as_py(), key[2].as_py()
        own, node, n, held, base, lost = (table.column(c).to_numpy() for c in ("own", "node", "n", "held", "base_n", "lost"))
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        both = base[left][:, None] - lost[left][:, None] - lost[right][None] + shared_counts(table.column("apart").combine_chunks(), left, right)
        link = 100 * both >= threshold * (n[left][:, None] + n[right][None] - both)
        link &= node[left][:, None] != node[right][None]
        found = [(node[left], link @ held[right])] + ([] if x == y else [(node[right], held[left] @ link)])
        return pa.table({"node": np.concatenate([a for a, _ in found]), "near": np.concatenate([b for _, b in found]).astype(np.int64)})

    return run


class Join:
    def __init__(self, docs: DataFrame, n: int, threshold: int, counts: bool):
        self.spark = docs.sparkSession
        prepare(self.spark)
        self.scratch, self.docs, self.n, self.t = Scratch(self.spark, measured=True), documents(docs, "doc_id", "text"), n, threshold
        self.counts = counts

    def texts(self, nodes: DataFrame) -> DataFrame:
        """A (doc_id, text) row for each of ``nodes(node)``; rows that share an id bring their other sets too."""
        ids = self.scratch.save(nodes.join(self.sets, "node").select(F.col("first").alias("doc_id")).distinct(), "ids")
        return self.docs.join(small(ids), "doc_id", "left_semi")

    def of_nodes(self, nodes: DataFrame, maker, schema: str) -> DataFrame:
        """What ``maker`` makes of the sets' texts, one row for each of ``nodes``."""
        rows = self.texts(nodes).mapInArrow(trimmed(maker), schema)
        return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]) if self.repeated else rows

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of similarity of at least the threshold."""
        save, t = self.scratch.save, self.t
        both = save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
        sets = save(self.of_nodes(both, segment_sets(self.n), SETS_SQL), "sets")
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("digests").alias(f"d{x}"), F.col("counts").alias(f"c{x}"))
        enough = lambda inter, union: inter * 100 >= union * t
        frags = F.arrays_zip(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)).alias("k"), F.col("da"), F.col("db"), F.col("ca"), F.col("cb"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(enough(F.least("na", "nb"), F.greatest("na", "nb"))).withColumn("f", frags)
        total = lambda col, when: F.aggregate(F.filter("f", when), F.lit(0).cast("long"), lambda s, x: s + col(x))
        same = lambda x: x["da"] == x["db"]
        least = lambda x: F.least(x["ca"], x["cb"]) - F.when(x["ca"] == x["cb"], 1).otherwise(0)
        judged = save(
            joined.withColumn("equal", total(lambda x: x["ca"], same)).withColumn("most", F.col("equal") + total(least, lambda x: ~same(x)))
            .withColumn("size", F.col("na") + F.col("nb"))
            .withColumn("sure", enough(F.col("equal"), F.col("size") - F.col("equal")))
            .filter(enough(F.col("most"), F.col("size") - F.col("most")))
            .select("a", "b", "size", "equal", "sure", F.transform(F.filter("f", lambda x: ~same(x)), lambda x: x["k"]).alias("differ")),
            "judged",
        )
        sure = judged.filter("sure").select("a", "b")
        open_ = judged.filter("not sure")
        cut = lambda x: sets.select(F.col("node").alias(x), F.posexplode("segments").alias("k", f"s{x}"))
        partial = (
            open_.select("a", "b", F.explode("differ").alias("k")).join(cut("a"), ["a", "k"]).join(cut("b"), ["b", "k"])
            .groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("sa", "sb"))).alias("partial"))
        )
        summed = open_.join(partial, ["a", "b"]).withColumn("inter", F.col("equal") + F.col("partial"))
        out = save(sure.union(summed.filter(enough(F.col("inter"), F.col("size") - F.col("inter"))).select("a", "b")), "links")
        self.scratch.drop("sets", "judged", "ids", "wanted")
        return out

    def front(self, rows: DataFrame) -> DataFrame:
        """Parsed rows -> a saved table ``key, node``: keys that are held more than once and are among a node's ``need`` rarest.

        Keys that are held once come first in the order, and go at once; most keys are such. A filter of fixed size tells
        most of them where the keys are read, so hardly any but shared ones are shuffled a second time.
        """
        keys = rows.select(F.explode("classes.keys").alias("keys")).select(F.explode("keys").alias("key"))
        often = self.scratch.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "often")
        passes = self.spark.sparkContext.broadcast(key_filter(often))
        kept = rows.select("node", "classes").mapInArrow(trimmed(passing(passes)), KEPT_SQL).select("node", "class", "need", "parts", F.explode("keys").alias("key"))
        shared = kept.join(often, "key").repartition("node", "class").dropDuplicates(["node", "class", "key"])
        one = Window.partitionBy("node", "class")
        rank = F.col("parts") - F.count(F.lit(1)).over(one) + F.row_number().over(one.orderBy("held", "key"))
        out = self.scratch.save(shared.withColumn("at", rank).filter("at <= need").select("key", "node"), "front")
        passes.destroy()  # 16 MB in the driver and in each worker
        return out

    def rarest(self, rest: DataFrame) -> DataFrame:
        """(key, node, label) of large groups -> the same with keys of finer segments, rarest first, as many as decide.

        Of a class's fine segments a pair can differ in ``need - 1`` at most, so among the ``need`` rarest of each side
        there is a common one; ``before`` holds the segments that come before it. At a pair's first common one, both have
        differed in all of these, which ``across`` checks against the sizes. Sets of one group that differ in more than a
        few places have rarer segments in front.
        """
        save = self.scratch.save
        named = save(rest.select("node", "label").distinct(), "named")
        fine = save(self.of_nodes(named.select("node"), fine_keys(self.n, self.t), FINE_SQL), "fine").select("node", "n", F.explode("classes").alias("c"))
        keys = fine.select("node", "n", "c.class", "c.need", F.posexplode("c.keys").alias("part", "key"))
        often = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "often")
        one = Window.partitionBy("node", "class")
        ranked = keys.join(often, "key", "left").withColumn("at", F.row_number().over(one.orderBy(F.coalesce("held", F.lit(1)), "key"))).filter("at <= need")
        ranked = ranked.withColumn("before", F.collect_list("part").over(one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
        return ranked.filter("held > 1").join(named, "node").select("key", "node", "label", "n", "before")

    def inside(self, label: DataFrame) -> DataFrame:
        """``label(node, label)`` -> ``node, near``: the rows of other sets of the same component that link with each set."""
        save, t = self.scratch.save, self.t
        named = save(label.join(self.sets.select("node", "held"), "node"), "named")
        grams = save(self.of_nodes(named.select("node"), gram_sets(self.n), GRAMS_SQL), "grams")
        base = grams.select(F.col("node").alias("label"), F.col("grams").alias("base"))
        joined = named.join(grams, "node").join(base, "label").select("label", "node", "n", "held", "grams", "base")
        apart = save(joined.mapInArrow(differences, "label long, node long, n long, held long, base_n long, lost long, apart array<long>"), "apart")
        sizes = apart.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("apart")).alias("total"))
        blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("total") / BLOCK_GRAMS)).cast("int")
        dealt = apart.join(sizes, "label").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        placed = dealt.select("label", "own", other, "node", "n", "held", "base_n", "lost", "apart")
        found = placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).groupBy("label", "x", "y").applyInArrow(block_links(t), "node long, near long")
        return found.groupBy("node").agg(F.sum("near").alias("near"))

    def degrees(self, links: DataFrame, label: DataFrame) -> DataFrame:
        """``node, near``: the rows of other sets that link with each set, from pairs between components and counts inside them."""
        held = self.sets.select(F.col("node").alias("b"), "held")
        between = links.union(links.select("b", "a")).join(held, "b").groupBy(F.col("a").alias("node")).agg(F.sum("held").alias("near"))
        return self.scratch.save(between.union(self.inside(label)).groupBy("node").agg(F.sum("near").alias("near")), "degrees")

    def run(self) -> DataFrame:
        save, scratch = self.scratch.save, self.scratch
        rows = save(self.docs.mapInArrow(trimmed(parsed(self.n, self.t)), PARSED_SQL), "parsed")
        with_set = rows.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "node")
        self.sets = save(with_set.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")), "nodes")
        ids = save(with_set.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("a")).filter("rows > 1"), "repeated")
        self.repeated = ids.limit(1).count() > 0
        tied = with_set.join(ids, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct()  # sets of one id
        shared = self.front(rows)
        hubs = shared.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub < far").select("key", "hub")
        pairs = save(shared.join(save(hubs, "hubs"), "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        links = self.verified(pairs)
        label = components(links, scratch)
        known = label.withColumnRenamed("node", "of")
        named = save(shared.join(known, shared.node == known.of, "left").select("key", "node", F.coalesce("label", "node").alias("label")), "named_front")
        mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size")).filter("least < most").select("key", "size")
        rest = save(named.join(save(mixed, "mixed"), "key"), "rest")
        few = rest.filter(f"size <= {FEW}").select("key", "node", "label", F.lit(0).alias("n"), F.array().cast("array<int>").alias("before"))
        found = across(few.union(self.rarest(rest.filter(f"size > {FEW}"))), self.t)
        between = self.verified(save(found.distinct().join(pairs, ["a", "b"], "left_anti"), "more"))
        joined = components(links.union(between).union(tied), scratch)
        whole = self.sets.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")).join(self.degrees(between, label), "node", "left") if self.counts else self.sets.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("near", F.lit(None).cast("long"))
        least = whole.groupBy("label").agg(F.min("first").alias("component_id"))
        links_ = F.coalesce("near", F.lit(0)) + F.col("held") - 1 if self.counts else F.lit(None).cast("long")
        named = save(whole.join(least, "label").select("node", "component_id", links_.alias("n_links")), "found")
        linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        out = rows.select(F.col("doc_id"), "n_shingles", F.when(linked, F.col("node")).alias("node")).join(named.hint("merge"), "node", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0 if self.counts else None).cast("long")).alias("n_links"))


def across(rest: DataFrame, threshold: int, members: int = 64) -> DataFrame:
    """(key, node, label, n, before) -> the pairs of a key whose labels differ; large keys are dealt out in salted blocks.

    Where sizes are given (n > 0), a pair whose segments ``before`` the key are more than its sizes let differ is left out.
    """
    sized = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").withColumn("blocks", F.ceil(F.sqrt(F.col("size") / members)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    part = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("label", "n", "before")]
    left = sized.withColumn("own", own).select("key", F.col("own").alias("x"), every.alias("y"), F.col("node").alias("a"), *part("a"))
    right = sized.withColumn("own", own).select("key", every.alias("x"), F.col("own").alias("y"), F.col("node").alias("b"), *part("b"))
    allowed = F.floor((F.col("na") + F.col("nb")) * (100 - threshold) / (100 + threshold))
    on = [left[c] == right[c] for c in ("key", "x", "y")] + [F.expr("a < b"), F.col("labela") != F.col("labelb")]
    near = (F.col("na") == 0) | (F.size(F.array_union("beforea", "beforeb")) <= allowed)
    return left.join(right, [*on, near]).select("a", "b")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: int = 80, counts: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per document: ``doc_id, n_shingles, component_id, n_links``.

    Two documents link when 100 * |intersection| >= threshold * |union| of their sets of lower-cased (A-Z) n-word
    shingles; ``component_id`` is the smallest id that links reach, ``n_links`` the number of all other rows that link
    with a row (null without ``counts``, which spares the counts inside components).
    """
    return Join(docs, n, threshold, counts).run()

"""BPE encoding and decoding through a table of distinct words.

Encoding: texts are split into words in blocks of bounded size. A block's texts become lists of positions in the
block's own word list, and its words go, once each, to the word groups that they hash to. In a group every distinct
word is encoded once for the whole corpus, and its ids go back to the blocks that asked, by position in their lists;
there the texts' ids are put together. Neither texts nor word occurrences are shuffled as rows: what moves are the
compressed positions, each block's distinct words, and their ids.

Decoding: a join of ids to pieces, done on Arrow arrays against the vocabulary (its size bounds the broadcast). The
file names no decoder, so decoding joins pieces by one blank, as the library does.

Blocks and words are written to the shared folder first, so a lost executor can't change how texts fell into blocks.

Defined cases: a null text is empty: no ids, decoded to the empty text; repeated ids are rows of their own; a text longer
than a block is a block of its own; nothing depends on the order of words or rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.pretokens import pieces, read_file
from quillspark.llm.runtime import Scratch, documents, give_back, prepare, trimmed
from quillspark.llm.token_counts import splitter

#: The least integer that takes five bytes in a list.
LONG = 192 + 63 * 256
#: Characters of text in a block (or one longer text), and texts in a stored row.
BLOCK, TOGETHER = 32 << 20, 64
#: Word groups, at least and at most, and the bytes of text for each between; a block's words fall into all of them.
GROUPS, GROUP_BYTES = (512, 8192), 64 << 20
#: Stored rows that leave a task at once.
STORED = 64
#: Encoded words of one group that a task keeps; a group's distinct words seldom exceed it, and then words are encoded again.
KNOWN = 1_000_000


def pack(a: np.ndarray) -> bytes:
    """Integers below 2**32 in one byte (below 192), two, or five, each place in a compressed stream of its own."""
    a = a.astype(np.uint32, copy=False)
    first = np.where(a < 192, a, np.where(a < LONG, 192 + ((a - np.uint32(192)) >> np.uint32(8)), 255)).astype(np.uint8)
    second = ((a[(a >= 192) & (a < LONG)] - np.uint32(192)) & np.uint32(255)).astype(np.uint8)
    rest = a[a >= LONG].astype("<u4").view(np.uint8).reshape(-1, 4).T
    done = [zstandard.ZstdCompressor(level=3).compress(x.tobytes()) for x in (first, second, rest)]
    return struct.pack("<II", *map(len, done[:2])) + b"".join(done)


def unpack(data: bytes) -> np.ndarray:
    n, m = struct.unpack("<II", data[:8])
    first, second, rest = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in (data[8 : 8 + n], data[8 + n : 8 + n + m], data[8 + n + m :]))
    out = first.astype(np.uint32)
    two = (first >= 192) & (first < 255)
    out[two] = 192 + ((out[two] - 192) << np.uint32(8)) + second
    out[first == 255] = np.ascontiguousarray(rest.reshape(4, -1).T).reshape(-1).view("<u4")
    return out


def groups_of(words: list[str], groups: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % groups


SPLIT_SQL = "block string, word_group int, rows array<long>, sizes array<int>, positions binary, words binary"


class _Local(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def block_rows(name: str, ids: list, texts: list[np.ndarray], local: dict[str, int], groups: int):
    """The stored rows of one block: its texts' positions, then its words by group. Takes the texts out of the list as they are stored."""
    n = len(local)
    counts = np.zeros(n, np.int64)
    for x in texts:
        np.add.at(counts, x.astype(np.int64), 1)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    del counts, order
    for i in range(0, len(texts), TOGETHER):
        part = texts[i : i + TOGETHER]
        texts[i : i + TOGETHER] = [None] * len(part)
        flat = np.concatenate(part)
        yield name, None, ids[i : i + TOGETHER], [len(x) for x in part], pack(rank[flat] if n else flat), None
    words = sorted(local)
    group = groups_of(words, groups)
    place = np.argsort(group, kind="stable")
    met, first = np.unique(group[place], return_index=True)
    for g, at in zip(met.tolist(), np.split(place, first[1:]), strict=True) if n else ():
        mine = [words[k] for k in at]
        where = rank[np.fromiter((local[w] for w in mine), np.int64, len(mine))]
        blob = zstandard.ZstdCompressor(level=3).compress("\n".join(mine).encode())
        yield name, g, None, None, pack(where), blob


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("block", pa.string()), ("word_group", pa.int32()), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("positions", pa.binary()), ("words", pa.binary())]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def split_blocks(file, groups: int):
    def run(batches):
        from pyspark import TaskContext

        split, task, number = splitter(file.value), TaskContext.get(), 0
        ids, texts, local, size = [], [], _Local(), 0

        def flush():
            name = f"{task.partitionId()}-{number}"
            rows = block_rows(name, ids, texts, local, groups)
            while some := list(islice(rows, STORED)):
                yield to_batch(some)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                length = len(text)
                if texts and size + length > BLOCK:
                    yield from flush()
                    ids, texts, local, size, number = [], [], _Local(), 0, number + 1
                words = split.split(text)
                ids.append(row), texts.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                size += length
        if texts:
            yield from flush()

    return run


def encode_words(file):
    """(word_group, block, positions, words) rows of whole word groups, group by group -> (block, positions, counts and ids), every distinct word encoded once."""

    def run(batches):
        split, known, group = splitter(file.value), {}, None
        for batch in batches:
            blocks, places, counts, ids = [], [], [], []
            for g, block, where, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = zstandard.ZstdDecompressor().decompress(blob).decode().split("\n")
                if g != group or len(known) + len(words) > KNOWN:
                    known.clear()
                group = g
                for w in words:
                    if w not in known:
                        known[w] = np.array(split.encode(w), np.uint32).tobytes()
                mine = [known[w] for w in words]
                blocks.append(block), places.append(where)
                counts.append(pack(np.fromiter(map(len, mine), np.uint32, len(mine)) // np.uint32(4))), ids.append(pack(np.frombuffer(b"".join(mine), np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(places, pa.binary()), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["block", "positions", "counts", "ids"])

    return run


def join_back(names):
    """One block's texts and its words' ids -> each text's ids and their decoding."""

    def run(key, left: pa.Table, right: pa.Table):
        lengths, parts, places = [], [], []
        for where, counts, ids in zip(*(right.column(c).to_pylist() for c in ("positions", "counts", "ids")), strict=True):
            places.append(unpack(where)), lengths.append(unpack(counts)), parts.append(unpack(ids))
        where = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        length = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(length)])[:-1]
        at, n = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        at[where], n[where] = starts, length
        vocabulary = pa.array(names.value, pa.string())
        for rows, sizes, positions in zip(*(left.column(c).to_pylist() for c in ("rows", "sizes", "positions")), strict=True):
            words = unpack(positions).astype(np.int64)
            each = n[words]
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(at[words] - ends[:-1], each) + np.arange(ends[-1])]
            cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists, decoded(lists, vocabulary)], names=["doc_id", "ids", "decoded"])

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def table(key, left, right):
        out = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in run(key, left, right)], schema=schema)
        give_back()
        return out

    return table


def decoded(ids: pa.ListArray, vocabulary: pa.Array) -> pa.Array:
    """Each list's pieces, joined by one blank; ids outside the vocabulary are passed over, as the library does."""
    flat = ids.flatten()
    if len(flat) and pc.max(flat).as_py() >= len(vocabulary):
        keep = [[i for i in x if i < len(vocabulary)] for x in ids.to_pylist()]
        return decoded(pa.array(keep, pa.list_(pa.int32())), vocabulary)
    joined = pa.ListArray.from_arrays(ids.offsets, vocabulary.take(flat.cast(pa.int64())))
    return pc.binary_join(joined, " ")


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, ids array<int>, decoded``; ``tokenizer`` is the file's path on the driver."""
    spark = docs.sparkSession
    prepare(spark)
    scratch, text = Scratch(spark), read_file(tokenizer)
    file, names = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(pieces(text))
    docs = documents(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(max(size // GROUP_BYTES, GROUPS[0]), GROUPS[1])
    split = scratch.save(docs.mapInArrow(trimmed(split_blocks(file, groups)), SPLIT_SQL), "blocks")
    asked = split.filter("word_group is not null").select("word_group", "block", "positions", "words").repartition("word_group").sortWithinPartitions("word_group")
    answered = asked.mapInArrow(trimmed(encode_words(file)), "block string, positions binary, counts binary, ids binary")
    texts = split.filter("word_group is null").select("block", "rows", "sizes", "positions")
    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(join_back(names), "doc_id long, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded(doc_id, ids array<int>)`` -> ``doc_id, decoded``; a null list is empty."""
    prepare(encoded.sparkSession)
    names = encoded.sparkSession.sparkContext.broadcast(pieces(read_file(tokenizer)))

    def run(batches):
        vocabulary = pa.array(names.value, pa.string())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded(batch.column(1), vocabulary)], names=["doc_id", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, decoded string")

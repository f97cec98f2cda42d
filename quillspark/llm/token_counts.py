"""Token counts by a two-tier lookup on the map side: no pre-token is shuffled.

First tier: a compact table of the lengths in tokens of frequent pre-tokens, broadcast; its size is the constant
``FREQUENT``, whatever the corpus. Second tier: a cache that a worker process keeps for all its tasks, into which a
missing pre-token's length goes when it is met first. Both tiers only save work, and each count equals the library's, so
the table may come from a sample: ``SAMPLE`` documents, drawn by hash, whose counts go straight to the driver. Texts are
then split and counted in one pass.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; rows are counted as they stand, repeated ids too; texts
of any length are counted whole; ties in the frequent table are broken by the pre-token; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.pretokens import Splitter, read_file
from quillspark.llm.runtime import documents, drawn, prepare

#: Entries of the broadcast table, and documents that name them (a bound; they only decide what is looked up where).
FREQUENT, SAMPLE = 32_768, 4_000
#: Lengths that a worker keeps beside the broadcast table (tens of MB).
CACHE = 250_000
_splitters: dict[int, Splitter] = {}
_caches: dict[int, Lengths] = {}


def splitter(file: str) -> Splitter:
    """One for each worker process and file."""
    key = hash(file)
    if key not in _splitters:
        _splitters.clear()
        _splitters[key] = Splitter(file)
    return _splitters[key]


class Lengths(dict):
    """Pre-token -> tokens; misses are encoded and kept, CACHE of them at most."""

    def __init__(self, split: Splitter):
        super().__init__()
        self._encode, self._frequent = split.encode, {}

    def start(self, frequent: dict[str, int]) -> None:
        """Takes the broadcast table in; what was met before stays."""
        if self._frequent is not frequent:
            self._frequent = frequent
            self.update(frequent)

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self._frequent) + CACHE:
            self.clear()
            self.update(self._frequent)
        n = self[word] = len(self._encode(word))
        return n


def lengths(file: str, frequent: dict[str, int]) -> Lengths:
    """The cache of this worker process."""
    key = hash(file)
    if key not in _caches:
        _caches.clear()
        _caches[key] = Lengths(splitter(file))
    _caches[key].start(frequent)
    return _caches[key]


def pre_tokens(file):
    def run(batches):
        split = splitter(file.value)
        for batch in batches:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(split.split(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return run


def counter(file, frequent):
    def run(batches):
        split = splitter(file.value)
        get = lengths(file.value, frequent.value).__getitem__
        for batch in batches:
            n = [sum(map(get, split.split(text))) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def frequent_words(docs: DataFrame, file, sample: int) -> list[str]:
    """The commonest pre-tokens of the sample, FREQUENT at most."""
    got = drawn(docs, docs.count(), sample, "tokens").select("text").mapInArrow(pre_tokens(file), "word string, n long").toArrow()
    summed = got.group_by("word").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("word", "ascending")])
    return summed.column("word").slice(0, FREQUENT).to_pylist()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_bytes, n_tokens, over_limit``; ``tokenizer`` is the file's path on the driver."""
    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = documents(docs, "doc_id", "text")
    text = read_file(tokenizer)
    file, split = context.broadcast(text), Splitter(text)
    frequent = context.broadcast({w: len(split.encode(w)) for w in frequent_words(docs, file, sample)})
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    counted = sized.mapInArrow(counter(file, frequent), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

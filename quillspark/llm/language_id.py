"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased code points, weighted by log(1 + count) * idf and scaled to length 1;
document frequencies cover all training rows. Weights are learned by follow-the-regularised-leader with elastic-net
penalties, on a bounded sample of the training rows, and then calibrated: one temperature is chosen by likelihood on a
part of the sample that the weights haven't seen.

Only ``text`` and ``lang`` of training rows are learned from, and only ``text`` is an input of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0, also when nothing could be learned; rows
with a null ``lang`` or no letter aren't learned from; a null id is no training row and not held out; repeated rows are
learned from as often as they stand; very long texts are read whole, in parts; of languages with equal chances the first
by name is taken; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import documents, drawn, prepare

#: Hash buckets of n-grams; rows that weights are fitted on (a bound, drawn by hash of the id); passes over them.
BUCKETS, SAMPLE, EPOCHS = 1 << 15, 6_000, 3
#: Of the sample, every so manieth row is for the temperature.
CALIBRATE = 5
#: Code points handled at a time.
PART = 1 << 18
UND = "und"


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal, for several classes."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int) -> np.ndarray:
        z = np.zeros((BUCKETS, classes))
        n = np.zeros((BUCKETS, classes))
        order = np.random.Generator(np.random.PCG64(7))
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                at, x, y = rows[k]
                w = self.weights(z[at], n[at])
                p = softmax(x @ w)
                p[y] -= 1
                g = np.outer(x, p)
                grown = n[at] + g * g
                z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / self.alpha * w
                n[at] = grown
        return self.weights(z, n)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter."""
    low = text.lower()
    out = np.zeros(BUCKETS, np.int64)
    letter = False
    for i in range(0, len(low), PART):
        part = low[max(0, i - 2) : i + PART]  # n-grams that cross a cut are in one part only
        letter = letter or has_letter(part)
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint32)
        new = min(i, 2)
        h = (c + np.uint32(1)) * np.uint32(2654435761)
        for n in range(1, 4):
            if n > 1:
                h = (h[:-1] ^ (c[n - 1 :] * np.uint32(n))) * np.uint32(2654435761)
            keep = h[max(0, new - n + 1) :]
            out += np.bincount(keep >> np.uint32(17), minlength=BUCKETS)
    return out if letter else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def frequencies(batches):
    """(text) -> how many of a task's texts have each bucket, and how many texts there are (bucket -1)."""
    held, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = counts(text)
            if c is not None:
                held += c > 0
                rows += 1
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(held[at], rows))], names=["bucket", "n"])


def features(batches):
    for batch in batches:
        at, n, langs, places = [], [], [], []
        for text, lang, place in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (c := counts(text)) is not None:
                where = np.flatnonzero(c)
                at.append(where.astype(np.int32)), n.append(c[where].astype(np.int32)), langs.append(lang), places.append(place)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array(langs, pa.string()), pa.array(places, pa.int64())], names=["at", "n", "lang", "place"])


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if text and self.classes else None
        if c is None:
            return UND, 0.0
        at = np.flatnonzero(c)
        p = softmax(self.vector(at, c[at]) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def train(rows: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """From ``rows(doc_id, text, lang)``, none of them null."""
    found = {r.bucket: r.n for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float64)
    got = drawn(rows, total, sample, "language").select("text", "lang", "place").mapInArrow(features, "at array<int>, n array<int>, lang string, place long").toArrow()
    got = got.sort_by([("place", "ascending"), ("lang", "ascending")])  # what is learned doesn't depend on partitions
    langs = got.column("lang").to_pylist()
    classes = sorted(set(langs))
    if not classes:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    model = Model(classes, idf, np.zeros((BUCKETS, len(classes))), 1.0)
    data = []
    for at, n, lang in zip(got.column("at"), got.column("n"), langs, strict=True):
        where = at.values.to_numpy()
        data.append((where, model.vector(where, n.values.to_numpy()), classes.index(lang)))
    fit, held = [r for k, r in enumerate(data) if k % CALIBRATE], data[::CALIBRATE]
    model.weights = Ftrl().fit(fit or held, len(classes), epochs)
    logits, y = np.array([x @ model.weights[at] for at, x, _ in held]), np.array([y for _, _, y in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.02, 10, 80), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``doc_id, held_out, lang_pred, score``; rows with held_out true aren't learned from."""
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs, "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = spark.sparkContext.broadcast(train(docs.filter(~out & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())))

    def run(batches):
        for batch in batches:
            got = [model.value.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

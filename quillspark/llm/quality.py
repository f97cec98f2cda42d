"""A quality classifier without gold labels: overlapping heuristics, weighed by expectation-maximisation, teach a scorer.

1. Labellers. Heuristics vote on each document: good, bad, in between, or nothing where a text is too short. All documents' vote patterns are counted.
2. Weak-label model. Expectation-maximisation over the counted patterns (their number is bounded by the labellers, not
   by the corpus) estimates the share of good documents and each labeller's rates of either vote given the truth; it
   gives each pattern a posterior.
3. Scorer. The posteriors of all documents are the soft labels of a logistic regression on hashed features of the
   text alone: byte trigrams with letters and digits folded, and word shapes. The features are written to the shared
   folder once; each step of the fit (limited-memory BFGS) is a pass over all of them, and only sums reach the driver.

A document is rejected when its score is below a threshold: half, or less where that would reject more than ``SPARED`` of
the documents whose labels are good. For that, every document is scored by weights that haven't seen it: a hash of the text
deals the documents into two halves, and weights learned from either half score the other one.

Gradients are sums of whole numbers (units of 2**-30), so what is learned doesn't depend on partitions.

Defined cases: a null text is empty; a text without words is rejected with score 0; with too few documents of one kind
to learn from, the posterior is the score; repeated rows are judged, and learned from, as often as they stand; very long
texts are measured whole; a score of just the threshold is good; extra columns are not read but to carry them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words as W
from quillspark.llm.runtime import Scratch, documents, prepare, trimmed

#: Votes; one in between is an outcome that can tell the kinds apart, one on a text too short to judge tells nothing.
BAD, GOOD, BETWEEN, SHORT = range(4)
#: Hash buckets, steps of the fit, weight of the penalty on squared weights (of the mean loss), steps it remembers.
BUCKETS, STEPS, PENALTY, MEMORY = 1 << 14, 14, 1e-5, 8
#: The share of good documents that the threshold may reject, its bounds, and its resolution.
SPARED, THRESHOLD, BINS = 0.005, (0.1, 0.5), 10_000
#: Gradients are counted in these units.
UNIT = 2.0**-30
#: Labellers by name: what they measure, a bound for bad (from it on) and one for good (up to it).
BOUNDS = {
    "symbols": (0.10, 0.04),  # bytes that are neither letters, digits, blanks nor common punctuation
    "capitals": (0.60, 0.20),  # capital among letters
    "repeats": (0.45, 0.15),  # words that equal one of the two before
    "variety": (0.70, 0.40),  # 1 - distinct words / words^0.9
    "lines": (0.30, 0.10),  # lines that were there before
    "bars": (0.12, 0.02),  # words that are a bare sign
    "marks": (0.30, 0.12),  # words that end in a sign beyond sentence punctuation
    "sentences": (0.0, 0.0),  # sentence ends among words: bad if there are none in a long text
}
NAMES = list(BOUNDS)
RESULT = ["score", "posterior", "votes", "keep"]
_KIND = np.full(256, 4, np.uint8)  # 0 blank, 1 small letter, 2 capital, 3 digit, 4 sign, 5 sentence punctuation
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[97:123], _FOLD[65:91], _FOLD[48:58], _FOLD[128:] = 97, 65, 48, 97


def measures(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    """The labellers' measures of one text."""
    n = len(hashes)
    if n == 0:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[part], minlength=6)
    again = np.zeros(n, bool)
    again[1:] |= hashes[1:] == hashes[:-1]
    again[2:] |= hashes[2:] == hashes[:-2]
    lines = [x for x in part.tobytes().split(b"\n") if len(x) > 2]
    one = (ends - starts == 1) & (_KIND[part[starts]] >= 4)
    last = part[ends - 1]
    tail = _KIND[last] == 4
    stops = np.isin(last, [0x2E, 0x3F, 0x21]).sum()
    letters = kinds[1] + kinds[2]
    return [
        kinds[4] / max(len(part), 1),
        kinds[2] / max(letters, 1),
        again.mean(),
        max(0.0, 1 - len(np.unique(hashes)) / n**0.9),
        1 - len(set(lines)) / max(len(lines), 1),
        one.mean(),
        (tail & ~one).mean(),
        stops / n,
    ]


def votes(values: list[float], n_words: int) -> list[int]:
    out = []
    for (bad, good), v, name in zip(BOUNDS.values(), values, NAMES, strict=True):
        if n_words == 0:
            out.append(BAD)
        elif name == "sentences":
            out.append(SHORT if n_words < 30 else GOOD if v >= 0.02 else BAD if v == 0 else BETWEEN)
        elif name in ("repeats", "variety", "lines") and n_words < 20:
            out.append(SHORT)
        else:
            out.append(BAD if v >= bad else GOOD if v <= good else BETWEEN)
    return out


def shape_counts(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashed counts: folded byte trigrams, word shapes, and whether words repeat the one before."""
    out = np.zeros(BUCKETS)
    if len(part) >= 3:
        c = _FOLD[part]
        h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    if len(hashes):
        size = np.minimum(ends - starts, 15)
        shape = (_KIND[part[starts]].astype(np.int64) * 8 + _KIND[part[ends - 1]]) * 16 + size
        out += 2.0 * np.bincount((shape * 2654435761 >> 7) % BUCKETS, minlength=BUCKETS)
        same = np.zeros(len(hashes), np.int64)
        same[1:] += hashes[1:] == hashes[:-1]
        same[2:] += 2 * (hashes[2:] == hashes[:-2])
        out += 2.0 * np.bincount(same * 7919 % BUCKETS, minlength=BUCKETS)
    return out


def shape_features(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The counts scaled to length 1."""
    out = shape_counts(part, starts, ends, hashes)
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def texts(column):
    """(row, bytes, word starts, word ends, word hashes) for each row."""
    data, at = W.utf8(column)
    for i, j in W.chunks(at):
        starts, ends, first = W.word_spans(data, at[i : j + 1])
        hashes, _ = W.word_hashes(data, at[i : j + 1], True)
        for k in range(i, j):
            a, b, base = first[k - i], first[k - i + 1], at[k] - at[i]
            yield k, data[at[k] : at[k + 1]], starts[a:b] - base, ends[a:b] - base, hashes[a:b]


def pattern(part, starts, ends, hashes) -> int:
    out = 0
    for v in votes(measures(part, starts, ends, hashes), len(hashes)):
        out = out * 4 + v
    return out


def counted_features(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order, and their counts."""
    f = shape_counts(part, starts, ends, hashes)
    where = np.flatnonzero(f)
    return where, f[where]


def labelled(batches):
    """(text, half) -> vote pattern, half, buckets and counts of each text, as bytes."""
    for batch in batches:
        got, at, n = [], [], []
        for _, *x in texts(batch.column(0)):
            where, counts = counted_features(*x)
            got.append(pattern(*x)), at.append(where.astype("<u2").tobytes()), n.append(counts.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["pattern", "half", "at", "n"])


LABELLED_SQL = "pattern int, half int, at binary, n binary"


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Patterns and halves of a batch; for each bucket of each row, the row, the bucket and the feature."""
    at, sizes = joined(batch.column(2), "<u2")
    n, _ = joined(batch.column(3), "<u4")
    owner = np.repeat(np.arange(len(batch)), sizes)
    n = n.astype(np.float64)
    norm = np.sqrt(np.bincount(owner, n * n, len(batch)))
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), owner, at.astype(np.int64), n / norm[owner]


def chances(w: np.ndarray, owner: np.ndarray, at: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * x, rows) + w[-1], -30, 30)))


def halves(model: int, half: np.ndarray) -> np.ndarray:
    """Whether a row is for a model to learn from: model 2 learns from all rows, 0 and 1 from one half each."""
    return np.ones(len(half), bool) if model == 2 else half == model


def gradients(shared):
    """Labelled rows -> sums over a task's rows, in units: (model, bucket, sum); bucket BUCKETS is the intercept, the next one the loss.

    The values are the weights of each model and, by vote pattern, the posterior and the share of good.
    """

    def run(batches):
        models, known, share = shared.value
        total = np.zeros((3, BUCKETS + 2), np.int64)
        for batch in batches:
            patterns, half, owner, at, x = rows_of(batch)
            y = np.array([known[p] for p in patterns.tolist()])
            kinds = (y / share + (1 - y) / (1 - share)) / 2
            for model, w in models.items():
                use = halves(model, half)
                p = chances(w, owner, at, x, len(batch))
                g = np.where(use, (p - y) * kinds, 0.0)
                total[model, :BUCKETS] += np.bincount(at, np.rint(g[owner] * x / UNIT), BUCKETS).astype(np.int64)
                total[model, BUCKETS] += np.rint(g / UNIT).astype(np.int64).sum()
                loss = -np.where(use, (y * np.log(p) + (1 - y) * np.log1p(-p)) * kinds, 0.0)
                total[model, BUCKETS + 1] += np.rint(loss / UNIT).astype(np.int64).sum()
        m, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[m, k])], names=["model", "bucket", "sum"])

    return run


def unseen_scores(shared):
    """Labelled rows -> (bin, n): how many good rows have a score in each bin, by the weights of the other half."""

    def run(batches):
        models, known, _ = shared.value
        total = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            patterns, half, owner, at, x = rows_of(batch)
            good = np.array([known[p] >= 0.5 for p in patterns.tolist()], bool)
            p = np.where(half == 0, *(chances(models[m], owner, at, x, len(batch)) for m in (1, 0)))
            total += np.bincount((p[good] * BINS).astype(np.int64), minlength=BINS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    return run


def unpack_votes(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 4 ** (len(NAMES) - 1 - k) % 4 for k in range(len(NAMES))], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each pattern, the share of good, and each labeller's rates [truth, labeller, vote]."""
    v = unpack_votes(patterns)
    cast = np.maximum((v < BETWEEN).sum(axis=1), 1)
    post = np.clip(1 - 1.5 * (v == BAD).sum(axis=1) / cast, 0.02, 0.98)  # start: few bad votes already weigh
    prior, rates = 0.8, np.zeros((2, len(NAMES), 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        for vote in range(3):
            rates[:, :, vote] = weight @ (v == vote)
        rates += 0.5  # no rate is 0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        log = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.where(v[:, k] == SHORT, 0.0, np.log(rates[:, k, np.minimum(v[:, k], BETWEEN)])) for k in range(len(NAMES)))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, prior, rates


class Descent:
    """Limited-memory BFGS of one model, a step for each pass over the rows. The last weight is the intercept."""

    def __init__(self, rows: int):
        self.rows, self.w = rows, np.zeros(BUCKETS + 1)
        self.base: tuple[float, np.ndarray, np.ndarray] | None = None  # loss, gradient and weights of the best point
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.step = np.zeros(BUCKETS + 1)

    def direction(self, g: np.ndarray) -> np.ndarray:
        d, used = g.copy(), []
        for s, y in reversed(self.past):
            used.append((s @ d) / (s @ y))
            d -= used[-1] * y
        if self.past:
            s, y = self.past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d *= 2.0  # a row's curvature is a quarter at most, with the intercept a half
        for (s, y), a in zip(self.past, reversed(used), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        return -d

    def advance(self, sums: np.ndarray) -> None:
        """From the sums at ``w``: go on, or back half of the way where the loss has grown."""
        w = self.w
        g = sums[:-1] * (UNIT / self.rows)
        g[:-1] += PENALTY * w[:-1]
        loss = sums[-1] * (UNIT / self.rows) + PENALTY / 2 * (w[:-1] @ w[:-1])
        if self.base and loss > self.base[0]:
            self.step = self.step / 2
            self.w = self.base[2] + self.step
            return
        if self.base:
            s, y = w - self.base[2], g - self.base[1]
            if s @ y > 1e-12:
                self.past = [*self.past, (s, y)][-MEMORY:]
        self.base = loss, g, w
        self.step = self.direction(g)
        self.w = w + self.step


def fit_scorers(rows: DataFrame, known: dict[int, float], share: float, sizes: list[int]) -> dict[int, np.ndarray]:
    """The weights of models 0 and 1 (either half of the labelled rows) and 2 (all of them)."""
    spark, found = rows.sparkSession, {m: Descent(n) for m, n in enumerate(sizes) if n}
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast(({m: d.w for m, d in found.items()}, known, share))
        sums = rows.mapInArrow(gradients(shared), "model int, bucket int, sum long").groupBy("model", "bucket").agg(F.sum("sum").alias("sum")).toArrow()
        total = np.zeros((3, BUCKETS + 2))
        total[sums.column("model").to_numpy(), sums.column("bucket").to_numpy()] = sums.column("sum").to_numpy()
        shared.destroy()
        for m, d in found.items():
            d.advance(total[m])
    return {m: d.base[2] for m, d in found.items()}


def threshold(rows: DataFrame, models: dict[int, np.ndarray], known: dict[int, float]) -> float:
    """The score that a document must reach: the highest bin's edge below which there are at most ``SPARED`` of all good rows."""
    if not {0, 1} <= models.keys():
        return THRESHOLD[1]
    shared = rows.sparkSession.sparkContext.broadcast((models, known, None))
    bins = {r.bin: r.n for r in rows.mapInArrow(unseen_scores(shared), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    shared.destroy()
    below = np.cumsum([bins.get(k, 0) for k in range(BINS + 1)])
    return float(np.clip(np.searchsorted(below, SPARED * below[-1], "right") / BINS, *THRESHOLD)) if below[-1] else THRESHOLD[1]


def quality(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, score, posterior, votes, keep`` and the columns to carry: one row per document.

    ``score`` is the scorer's chance of good (0 to 1), ``posterior`` the weak-label model's, ``votes`` the labellers' as
    text, ``keep`` false for documents that are rejected. Carried columns may have any name but these five.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs, "doc_id", "text", *[c for c in carry if c != "text"])
    carried = [docs.columns.index(c) for c in carry]
    scratch = Scratch(spark)
    half = F.pmod(F.xxhash64("text", F.lit("quality")), F.lit(2)).cast("int").alias("half")
    rows = scratch.save(docs.select("text", half).mapInArrow(trimmed(labelled), LABELLED_SQL), "labelled")
    counted = sorted(rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("half").alias("second")).collect())
    patterns, counts = np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], float)
    posterior, _, _ = expectation_maximisation(patterns, counts) if len(patterns) else (np.zeros(0), 0.0, None)
    known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    total, second, bad = (sum(x) for x in zip(*((r.n, r.second, r.n * (known[r.pattern] < 0.5)) for r in counted), strict=True)) if counted else (0, 0, 0)
    learned, least = None, THRESHOLD[1]
    if min(bad, total - bad) >= 5:
        share = float(np.clip(posterior @ counts / total, 0.05, 0.95))
        models = fit_scorers(rows, known, share, [total - second, second, total])
        learned, least = models[2], threshold(rows, models, known)
    scratch.drop("labelled")
    shared = spark.sparkContext.broadcast((known, learned, least))
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        known, w, least = shared.value
        for batch in batches:
            scores, posts, said, keep = [], [], [], []
            for _, *x in texts(batch.column(1)):
                v = votes(measures(*x), len(x[3]))
                p = 0
                for vote in v:
                    p = p * 4 + vote
                post = known.get(p, 0.5)
                score = post if w is None else float(1 / (1 + np.exp(-np.clip(shape_features(*x) @ w[:-1] + w[-1], -30, 30))))
                if len(x[3]) == 0:
                    score = post = 0.0
                scores.append(score), posts.append(post), keep.append(score >= least)
                said.append(json.dumps({n: ("bad", "good", "between", None)[k] for n, k in zip(NAMES, v, strict=True)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(posts, pa.float64()), pa.array(said), pa.array(keep), *[batch.column(k) for k in carried]], names=["id", *RESULT, *[names[k] for k in carried]])

    schema = T._parse_datatype_string("score double, posterior double, votes string, keep boolean")
    fields = [T.StructField("id", docs.schema.fields[0].dataType), *schema.fields, *[T.StructField(names[k], docs.schema.fields[k].dataType) for k in carried]]
    return docs.toDF(*names).mapInArrow(trimmed(run), T.StructType(fields)).toDF("doc_id", *RESULT, *carry)

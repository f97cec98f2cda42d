"""Secret scans: fixed patterns, and a password guess-cost model for values in credential contexts.

Fixed patterns give the spans ``assign``, ``access`` and ``hex``. Values that stand where credentials stand, those of
``assign`` among them, are scored by the number of guesses that an attacker needs, as in password strength meters:
dynamic programming finds the cheapest way to segment the value into known words, dates, repeats, keyboard walks and
brute-force characters, each priced by the logarithm of its guesses, plus a price for each boundary. Known words are the
``DICTIONARY`` commonest words of the corpus itself, counted over all documents and ranked by that count, and a short
list of common passwords before them; a word costs its rank. Values of at least ``min_log10_guesses`` that no fixed spans
cover wholly add ``guess`` spans. The cost of a value is linear in its length, that of a scan in the text's.

Spans are [start, end) in code points of the whole text. Defined cases: a null text is empty and has no spans; texts
of any length are scanned whole; rows are judged one by one, so repeated ids and rows don't matter; words of one count
are ranked by spelling; where nothing is in the table, nothing is known but the list; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.runtime import documents, prepare, trimmed

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 and more of AKIA[A-Z0-9]+
HEX = re.compile(r"[0-9a-f]{24,}")  # 24 and more of [0-9a-f]+
#: Where a credential's value follows: a naming word, a sign or "is", perhaps a quote.
CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|passcode|pwd|secret|token|bearer|credentials?|(?:api|access|private|secret|signing|auth|encryption)[_ -]?key|pin)"
    r"[\"']?\s{0,3}(?:=>|->|:=|[:=]|\bis\b)\s{0,3}[\"'`]?([^\s\"'`<>,;|]{8,})",
    re.I | re.A,
)
_CONTEXT_WORD = re.compile(r"pass|pwd|secret|token|bearer|credential|key|pin", re.I | re.A)
#: Words of the corpus that are known at most (about 1 MB, broadcast), and their letters.
DICTIONARY, SHORTEST, LONGEST = 50_000, 3, 20
#: Common words of passwords, commonest first; a rank is the number of guesses.
COMMON = (
    "password pass word admin qwerty letmein welcome login user test guest root master secret hello love money monkey dragon "
    "football baseball soccer hockey summer winter spring autumn sunshine princess shadow michael jordan super batman trustno "
    "access system server database default public private token key changeme example sample dummy placeholder your insert here "
    "company office home work house family mother father friend happy lucky angel flower star computer internet google windows "
    "linux apple orange banana cookie coffee pepper ginger tiger lion eagle wolf bear horse cat dog bird fish black white blue "
    "green red yellow silver gold diamond crystal monday tuesday wednesday thursday friday saturday sunday january february march "
    "april may june july august september october november december the and for you are not with this that from have more when what"
).split()
#: Rows of a keyboard, and runs that are typed like one.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
_RANK = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: log10 of the guesses for each further segment.
BOUNDARY = math.log10(2)
WALK = 24


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for k, row in enumerate(ROWS):
        for i, c in enumerate(row):
            near.setdefault(c, set()).update(row[max(0, i - 1) : i + 2])
            if k < 3:  # the key below stands half a key to the right
                for j in (i - 1, i):
                    if 0 <= j < len(ROWS[k + 1]):
                        near[c].add(ROWS[k + 1][j])
                        near.setdefault(ROWS[k + 1][j], set()).add(c)
    return near


_NEAR = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def folded(value: str) -> str:
    """Lower case, code point by code point, so that places stay."""
    return "".join(c if len(d := c.lower()) != 1 else d for c in value)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of every priced segment, by end."""
    low = folded(value)
    plain = low.translate(LEET)
    dates: dict[int, list[int]] = {}
    for i in range(len(low)):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            dates.setdefault(m.end(), []).append(i)
    walk = repeat = 1  # lengths of the walk and the repeat that end at i
    for i in range(1, len(value) + 1):
        c = low[i - 1]
        walk = walk + 1 if i > 1 and c in _NEAR.get(low[i - 2], ()) and c != low[i - 2] else 1
        repeat = repeat + 1 if i > 1 and c == low[i - 2] else 1
        yield i - 1, i, _brute(value[i - 1])
        for start in range(max(0, i - LONGEST), i - SHORTEST + 1):
            for form, leet in ((low, 0.0), (plain, BOUNDARY)):
                if rank := ranks.get(form[start:i]):
                    upper = 0.0 if value[start:i] == low[start:i] else BOUNDARY
                    yield start, i, math.log10(rank) + upper + leet + BOUNDARY
        for start in dates.get(i, ()):
            yield start, i, math.log10(100 if i - start == 4 else 36_500) + BOUNDARY
        for length in range(3, min(walk, WALK) + 1):
            yield i - length, i, math.log10(40 * length * 4) + BOUNDARY
        if repeat >= 3:
            yield i - repeat, i, math.log10(95 * repeat) + BOUNDARY
        for size in (2, 3, 4, 6, 8):  # a block repeated: one more costs little
            if i >= 2 * size and low[i - size : i] == low[i - 2 * size : i - size]:
                yield i - size, i, BOUNDARY


def log10_guesses(value: str, ranks: dict[str, int] = _RANK) -> float:
    """The logarithm of the guesses of the cheapest segmentation."""
    best = [0.0] + [math.inf] * len(value)
    for start, end, price in segments(value, ranks):
        best[end] = min(best[end], best[start] + price)
    return best[-1]


def ranked(words: list[str]) -> dict[str, int]:
    """Ranks of the common passwords, and of further words, commonest first, after them."""
    out = dict(_RANK)
    for word in words:
        out.setdefault(word, len(out) + 1)
    return out


def corpus_words(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The commonest words of all texts, counted where they are read before anything is shuffled."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(SHORTEST, LONGEST))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.select("word").toArrow().column("word").to_pylist()


def uncovered(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether some character of each of the found ranges is in no base span; both are in order of start."""
    out, at, reach = [], 0, []  # reach: runs of characters that base spans hold
    for s, _, e in base:
        if reach and s <= reach[-1][1]:
            reach[-1][1] = max(reach[-1][1], e)
        else:
            reach.append([s, e])
    for start, end in found:
        while at < len(reach) and reach[at][1] < end:
            at += 1
        out.append(at == len(reach) or reach[at][0] > start)
    return out


def scan(text: str, least: float, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, int, float | None]]:
    """All spans in order, as (start, kind, end, log10 of a credential value's guesses)."""
    assigned = [m for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans = [(m.start(), 0, m.end(), log10_guesses(m.group(2), ranks)) for m in assigned]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: s[:3])
    if _CONTEXT_WORD.search(text):
        values = [(m.start(1), m.start(1) + len(m.group(1).rstrip(".!?):]}"))) for m in CONTEXT.finditer(text)]
        values = [(s, e) for s, e in values if e - s >= 8]
        for (s, e), left in zip(values, uncovered(values, [x[:3] for x in spans]), strict=True):
            if left and (cost := log10_guesses(text[s:e], ranks)) >= least:
                spans.append((s, 3, e, cost))
        spans.sort(key=lambda s: s[:3])
    return spans


SPAN = pa.struct([("kinds", pa.string()), ("starts", pa.int32()), ("ends", pa.int32()), ("log10_guesses", pa.float64())])
SPANS_SQL = "array<struct<kinds:string,starts:int,ends:int,log10_guesses:double>>"


def scanner(least: float, ranks):
    def run(batches):
        known = ranked(ranks.value)
        for batch in batches:
            found = [[(KINDS[k], s, e, cost) for s, k, e, cost in scan(text, least, known)] if text else [] for text in batch.column(1).to_pylist()]
            spans = pa.array([[dict(zip(("kinds", "starts", "ends", "log10_guesses"), x, strict=True)) for x in row] for row in found], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "spans"])

    return run


def secret_scan(docs: DataFrame, min_log10_guesses: float = 9.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, text``, the columns to carry, and ``spans: array<struct<kinds, starts, ends, log10_guesses>>``.

    Spans are in order of start, then kind; ``log10_guesses`` is null but for values of credentials. Carried columns may
    have any name but these three.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs, "doc_id", "text", *carry)
    ranks = spark.sparkContext.broadcast(corpus_words(docs))
    names = [f"c{k}" for k in range(len(docs.columns))]
    fields = [T.StructField(name, f.dataType) for name, f in zip(names, docs.schema.fields, strict=True)]
    plain = docs.toDF(*names)
    found = plain.mapInArrow(trimmed(scanner(min_log10_guesses, ranks)), T.StructType([*fields, T.StructField("spans", T._parse_datatype_string(SPANS_SQL))]))
    return found.toDF(*docs.columns, "spans")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``; null stays null."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["starts"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["starts"] - acc["at"]), F.lit(mark))).alias("out"),
        F.greatest(acc["at"], s["ends"]).alias("at"),
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))

"""Chat formatting by quotation linking.

Lines that begin with ``>`` signs are quotes of that level. Each message is parsed into its own words, without quotes
and the lines that announce them, and its quoted passages (runs of lines of one level). Passages and messages are cut
into sentences, normalised (lower case, single blanks) and hashed, so that other line breaks don't matter; a passage's
sentences are joined to the message that said them first: an earlier one of the same conversation, or else the first
of any earlier message of another. The message that most of the shallowest quotes' text comes from is replied to.

Replies within a conversation form trees, whose roots are messages that quote none of its messages. Conversations come
in reply order: trees by their first turn, and within a tree each reply after what it replies to (preorder, replies to
one message by turn). The order is found by ranking the tree's tour with pointer jumping, so neither a long chain of
replies nor a message with very many replies meets in one task.

Defined cases: a null text is an empty message; quotes of unknown text are cut out and linked to nothing; rows with one
(conv_id, turn) are one message for linking and keep a row each; a null conv_id or turn is linked to nothing; of messages
that equally much of a quote comes from, a nearer one wins, then the later; very long messages are parsed whole; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ordering import with_next
from quillspark.llm.runtime import Scratch, documents, prepare

_MARK = re.compile(r"(?:[ \t]?>)+[ \t]?")
#: A line that announces a quote, where one follows.
_ANNOUNCE = re.compile(r".{0,200}\b(?:wrote|writes|said|schrieb|a écrit|écrit|escribió)\b.{0,80}:\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
PARSED_SQL = "conv_id long, turn long, role string, body string, own array<long>, quotes array<struct<passage:int,level:int,hash:long,size:int>>"


def sentences(text: str) -> list[str]:
    return [s for s in (" ".join(x.lower().split()) for x in _SENTENCE.split(text)) if s]


def hashed(sentence: str) -> int:
    return int.from_bytes(hashlib.blake2b(sentence.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text), outermost markers removed."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_ = False
    for line in text.split("\n"):
        m = _MARK.match(line)
        if m:
            level, rest = m.group(0).count(">"), line[m.end() :]
            if not open_:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCE.match(own[-1]):
                    own.pop()
            if _ANNOUNCE.match(rest):
                open_ = True
                continue
            if not open_ or not passages or passages[-1][0] != level:
                passages.append((level, []))
            passages[-1][1].append(rest)
            open_ = True
        else:
            open_ = False
            own.append(line)
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def parser(batches):
    quote = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
    for batch in batches:
        bodies, own, quotes = [], [], []
        for text in batch.column(3).to_pylist():
            text = text or ""
            body, passages = parse(text) if ">" in text else (text.strip("\n"), [])
            bodies.append(body)
            own.append(sorted({hashed(s) for s in sentences(body)}))
            quotes.append([{"passage": k, "level": level, "hash": hashed(s), "size": len(s)} for k, (level, q) in enumerate(passages) for s in sentences(q)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(bodies, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, quote)],
            names=["conv_id", "turn", "role", "body", "own", "quotes"],
        )


def linked(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, to_conv, to_turn, size``: the message that each quoting message replies to."""
    keyed = parsed.filter("conv_id is not null and turn is not null")
    quotes = keyed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    said = keyed.select("conv_id", "turn", F.explode("own").alias("hash")).join(quotes.select("hash").distinct(), "hash", "left_semi")
    local = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("local"))
    anywhere = said.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))).alias("first"))
    found = (
        quotes.join(local, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
        .withColumn("near", F.coalesce(F.col("local") < F.col("turn"), F.lit(False)))
        .withColumn("to_conv", F.when(F.col("near"), F.col("conv_id")).when(F.col("first.conv") < F.col("conv_id"), F.col("first.conv")))
        .withColumn("to_turn", F.when(F.col("near"), F.col("local")).when(F.col("first.conv") < F.col("conv_id"), F.col("first.turn")))
        .filter("to_conv is not null")
    )
    sized = found.groupBy("conv_id", "turn", "level", "to_conv", "to_turn").agg(F.sum("size").alias("size"))
    best = F.max(F.struct(-F.col("level"), F.col("to_conv") == F.col("conv_id"), "size", "to_turn", "to_conv")).alias("b")
    return sized.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("b.to_conv").alias("to_conv"), F.col("b.to_turn").alias("to_turn"), F.col("b.size").alias("size"))


def reply_order(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(conv_id, turn, parent)`` -> ``conv_id, turn, thread, position``: preorder positions in each message's tree.

    A tour goes down into and up out of every message; ranking it from its end by pointer jumping takes as many rounds as
    the logarithm of the longest tour.
    """
    nodes = links.select("conv_id", "turn").union(links.select("conv_id", F.col("parent").alias("turn"))).distinct()
    looked = scratch.save(with_next(links.select("conv_id", "parent", "turn"), ["conv_id", "parent", "turn"], scratch), "siblings")
    sibling = looked.select("conv_id", "turn", "parent", F.when((F.col("next.conv_id") == F.col("conv_id")) & (F.col("next.parent") == F.col("parent")), F.col("next.turn")).alias("sibling"))
    child = links.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    local = scratch.save(nodes.join(sibling, ["conv_id", "turn"], "left").join(child, ["conv_id", "turn"], "left"), "tour_nodes")
    down = local.select("conv_id", "turn", F.lit(0).alias("up"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_up"), F.lit(1).cast("long").alias("n"))
    up = local.select("conv_id", "turn", F.lit(1).alias("up"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_up"), F.lit(0).cast("long").alias("n"))
    # n counts the ways down from here to the tour's end; the end is the root's way up, and names the tree
    steps = scratch.save(down.union(up).withColumn("last", F.col("turn")), "tour0")
    while True:
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("far"), F.col("to_up").alias("far_up"), F.col("n").alias("far_n"), F.col("last").alias("far_last"))
        steps = scratch.save(
            steps.join(ahead, ["conv_id", "to", "to_up"], "left").select(
                "conv_id", "turn", "up", F.col("far").alias("to"), F.coalesce("far_up", F.lit(1)).alias("to_up"),
                (F.col("n") + F.coalesce("far_n", F.lit(0))).alias("n"), F.coalesce("far_last", "last").alias("last"),
            ),
            "tour",
        )
        if steps.filter("to is not null").limit(1).count() == 0:
            break
    ranked = steps.filter("up = 0").select("conv_id", "turn", F.col("last").alias("thread"), "n")
    whole = ranked.filter("turn = thread").select("conv_id", "thread", F.col("n").alias("size"))
    return ranked.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "thread", (F.col("size") - F.col("n")).alias("position"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` -> a row for each message, without quotes, in its reply order.

    ``conv_id, turn, role, body, n_quotes, reply_conv, reply_turn, thread, position, formatted``. Sorted by conv_id, thread,
    position and turn, the rows are the conversation; ``formatted`` is the message in chat markup.
    """
    prepare(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession)
    parsed = scratch.save(documents(conversations, "conv_id", "turn", "role", "text").mapInArrow(parser, PARSED_SQL), "parsed")
    links = scratch.save(linked(parsed), "links")
    within = links.filter("to_conv = conv_id").select("conv_id", "turn", F.col("to_turn").alias("parent"))
    order = reply_order(within, scratch)
    out = parsed.join(links, ["conv_id", "turn"], "left").join(order, ["conv_id", "turn"], "left")
    passages = F.size(F.array_distinct(F.transform("quotes", lambda q: q["passage"])))
    role = F.coalesce("role", F.lit("user"))
    return out.select(
        "conv_id", "turn", "role", "body", passages.alias("n_quotes"), F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"),
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("position", F.lit(0).cast("long")).alias("position"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n")).alias("formatted"),
    )

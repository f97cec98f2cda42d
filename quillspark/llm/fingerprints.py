"""Merkle fingerprints of documents over sections and paragraphs; DataFrame functions only.

A text is cut into sections (after empty lines) and a section into paragraphs (lines). A paragraph's node is the hash of
its text, a section's that of its paragraphs' nodes in order, and the root's that of the sections'. So roots are equal
just when texts are, and where roots differ, ``locate_edits`` walks down the branches that differ.

Below a paragraph stand its pieces: runs up to a sentence end, of PIECE code points at most; no character is dropped. A
piece's node is 58 bits of its hash and 6 bits of its size. Equal branches have equal pieces, so what two trees share is
told by their pieces, each weighed by its size: likeness is twice the size of the shared pieces by the size of all, 1
for equal roots alone. The fingerprint is ``root:pieces``: the root, and the tree's distinct pieces, all of them, in hex.

Defined cases: a null text is empty; an empty text's likeness to another is 0; rows alike in id and text are one
document; documents with one id follow each other by their texts' hashes; a null id sorts first; very long texts have
trees of their size, compared in time that grows with it; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ordering import with_next
from quillspark.llm.runtime import Scratch, documents, prepare

#: Code points of a piece before its sentence end, and bits of a piece's node that hold its size (below 64).
PIECE, SIZE_BITS = 48, 6
#: Stands for a null id, and sorts first.
NO_ID = -(1 << 63)
_PIECES = r"[^.!?]{1,%d}[.!?]{0,8}\s?|[.!?]{1,8}\s?" % PIECE


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def merkle(text: Column) -> Column:
    """The tree: ``array<struct<hash, paragraphs: array<struct<hash, pieces: array<long>>>>>``."""
    piece = lambda p: F.shiftleft(F.xxhash64(p), SIZE_BITS).bitwiseOR(F.char_length(p).cast("long"))
    pieces = lambda line: F.transform(F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0)), piece)
    paragraphs = lambda part: F.transform(F.split(part, r"(?<=\n)"), lambda line: F.struct(F.sha2(line, 256).alias("hash"), pieces(line).alias("pieces")))
    sections = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)"), paragraphs)
    return F.transform(sections, lambda p: F.struct(_node(p["hash"]).alias("hash"), p.alias("paragraphs")))


def root(tree: Column) -> Column:
    return _node(tree["hash"])


def leaves(tree: Column) -> Column:
    """A tree's distinct pieces."""
    return F.array_distinct(F.flatten(F.transform(tree, lambda s: F.flatten(s["paragraphs"]["pieces"]))))


def fingerprint(root_: Column, leaves_: Column) -> Column:
    """``root:pieces``."""
    return F.concat(root_, F.lit(":"), F.array_join(F.transform(leaves_, lambda p: F.lower(F.hex(p))), ","))


def parsed(fingerprint_: Column) -> tuple[Column, Column]:
    """A fingerprint's root and pieces."""
    texts = F.filter(F.split(F.substring_index(fingerprint_, ":", -1), ","), lambda h: h != "")
    return F.substring_index(fingerprint_, ":", 1), F.transform(texts, lambda h: F.conv(h, 16, -10).cast("long"))


def _size(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: total + p.bitwiseAND(F.lit((1 << SIZE_BITS) - 1).cast("long")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """0 to 1, from two trees' roots and pieces."""
    (root_a, x), (root_b, y) = a, b
    near = 2.0 * _size(F.array_intersect(x, y)) / F.greatest(_size(x) + _size(y), F.lit(1))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(near, F.lit(0.999999)))


def locate_edits(before: Column, after: Column) -> Column:
    """From two trees, the (section, paragraph) positions in ``after`` whose nodes ``before`` doesn't have."""
    lines = lambda tree: F.flatten(F.transform(tree, lambda s: s["paragraphs"]["hash"]))
    sections, paragraphs = F.array_except(after["hash"], before["hash"]), F.array_except(lines(after), lines(before))
    changed = lambda s, i: F.when(
        F.array_contains(sections, s["hash"]),
        F.transform(F.filter(F.sequence(F.lit(0), F.size(s["paragraphs"]) - 1), lambda j: F.array_contains(paragraphs, F.get(s["paragraphs"]["hash"], j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph"))),
    ).otherwise(F.array().cast("array<struct<section:int,paragraph:int>>"))
    return F.flatten(F.transform(after, changed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, tree, fingerprint``."""
    trees = documents(docs, "doc_id", "text").withColumn("tree", merkle(F.col("text")))
    return trees.select("doc_id", "tree", fingerprint(root(F.col("tree")), leaves(F.col("tree"))).alias("fingerprint"))


def successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs(o, h, n)`` -> each distinct (o, h) with the one after it (the first after the last): ``o, h, n, rows, next_o, next_h``."""
    ids = docs.groupBy("o", "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    ahead = scratch.save(with_next(ids, ["o", "h"], scratch), "ahead")
    first = ahead.agg(F.min(F.struct("o", "h")).alias("first")).first()["first"]
    wrap = F.struct(F.lit(first["o"]).cast("long").alias("o"), F.lit(first["h"]).cast("long").alias("h")) if first else F.col("next")
    return ahead.withColumn("next", F.coalesce("next", wrap)).select("o", "h", "n", "rows", F.col("next.o").alias("next_o"), F.col("next.h").alias("next_h"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text, its edit (the last quarter replaced by as much of the next text's start) and their likeness.

    ``docs(doc_id, text, ...)`` -> ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next,
    edits`` with ``edits`` the (section, paragraph) branches that differ.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # the two joins with texts need the same columns, so that they share one shuffle; the id is read back from o
    keyed = documents(docs, "doc_id", "text").select(text.alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("o"), F.xxhash64(text).alias("h"))
    order = successors(keyed.select("o", "h", F.char_length("text").alias("n")), scratch)
    wants = order.select(F.col("next_o").alias("o"), F.col("next_h").alias("h"), F.col("o").alias("to_o"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    heads = keyed.join(wants, ["o", "h"]).select("to_o", "to_h", F.expr("substring(text, 1, k)").alias("head"), merkle(F.col("text")).alias("next_tree"))
    heads = heads.select("to_o", "to_h", "head", root(F.col("next_tree")).alias("next_root"), leaves(F.col("next_tree")).alias("next_leaves"))
    if order.filter("rows > 1").limit(1).count():
        heads = heads.dropDuplicates(["to_o", "to_h"])
    heads = heads.withColumnsRenamed({"to_o": "o", "to_h": "h"})
    both = keyed.join(heads, ["o", "h"]).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) as int)), head)"))
    both = both.withColumns({"tree": merkle(F.col("text")), "edited_tree": merkle(F.col("edited"))})
    both = both.withColumns({"root": root(F.col("tree")), "leaves": leaves(F.col("tree")), "edited_root": root(F.col("edited_tree")), "edited_leaves": leaves(F.col("edited_tree"))})
    tree_of = lambda x: (F.col(f"{x}root"), F.col(f"{x}leaves"))
    return both.select(
        F.when(F.col("o") != NO_ID, F.col("o")).alias("doc_id"), "n_chars", "edited", fingerprint(*tree_of("")).alias("fingerprint"), fingerprint(*tree_of("edited_")).alias("edited_fingerprint"),
        likeness(tree_of(""), tree_of("edited_")).alias("near_edited"),
        likeness(tree_of(""), tree_of("next_")).alias("near_next"),
        locate_edits(F.col("tree"), F.col("edited_tree")).alias("edits"),
    )

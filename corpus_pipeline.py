"""A corpus pipeline: quality, near duplicates, benchmark contamination, secrets, token ids.

Each stage takes the documents that the one before kept and returns documents in the same columns; the last returns
``doc_id, n_tokens, ids``. Between stages the documents are written as Parquet in the shared folder and read again.

Defined cases: texts that are null or have no words go with the first stage; rows that share an id stay or go together
in the second and third stage; a null id is nobody's duplicate and can't be named by a match, so it stays there; very
long texts and repeated rows are handled like others; columns beside ``doc_id`` and ``text`` go along untouched, whatever
their names, but ``n_chars``, which follows a redacted text where the table has it; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe_codec import bpe_encode
from quillspark.llm.decontaminate import contamination
from quillspark.llm.ngram_join import ngram_jaccard_join
from quillspark.llm.quality import quality
from quillspark.llm.runtime import Scratch, small
from quillspark.llm.secrets import redacted, secret_scan

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _without(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those whose id is among ``ids(doc_id)``."""
    return docs.join(small(Scratch(spark).save(ids.distinct(), "gone")), "doc_id", "left_anti").select(*_named(docs))


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and the whole other row as ``row``, so that no name clashes with a stage's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))


def _unpacked(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of documents again, in their order, but for ``changed``."""
    return found.select(*[changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c)).alias(c) for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return _unpacked(quality(_packed(docs), carry=("text", "row")).filter("keep"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near duplicates (five-word shingles, similarity 0.8)."""
    groups = ngram_jaccard_join(docs, n=5, threshold=80, counts=False)
    return _without(spark, docs, groups.filter("component_id <> doc_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(spark, docs, found.select("doc_id"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and lengths to match."""
    found = secret_scan(_packed(docs), carry=("row",))
    clean = found.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text"), "row", (F.size("spans") > 0).alias("changed"))
    if "n_chars" not in docs.columns:
        return _unpacked(clean, docs.columns)
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return _unpacked(clean, docs.columns, n_chars=F.when(F.col("changed"), length).otherwise(F.col("row").getField("n_chars")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    out = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

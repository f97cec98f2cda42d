"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import sql
from quillspark.llm.bpe_codec import bpe_encode
from quillspark.llm.chat_format import format_conversations
from quillspark.llm.decontaminate import contamination
from quillspark.llm.fingerprints import edited_fingerprints
from quillspark.llm.language_id import language_id
from quillspark.llm.ngram_join import ngram_jaccard_join
from quillspark.llm.quality import quality
from quillspark.llm.secrets import secret_scan, written
from quillspark.llm.substring_dedup import substring_dedup
from quillspark.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=90)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("edits").cast("long").alias("n_edits"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents")).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kinds"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kinds"] != "guess")
    strong = F.size(F.filter("spans", lambda s: s["log10_guesses"] >= 9.0)).cast("long").alias("n_strong")
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), of("guess"), strong)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1,
        "op2_substring_dedup": op2,
        "op3_token_counts": op3,
        "op4_language_id": op4,
        "op5_bpe_codec": op5,
        "op6_secret_scan": op6,
        "op7_quality_classifier": op7,
        "op8_benchmark_decontamination": op8,
        "op9_merkle_fingerprints": op9,
        "op10_chat_format": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": sql.OP1, "op2_substring_dedup": sql.OP2}

"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracle
from .audit import audit
from .bpe import bpe
from .brown import lm_scores
from .chat import canonical_turns, digests, format_chats
from .common import table, vocabulary
from .jaccard import jaccard_join
from .langid import language_id
from .neardup import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality import quality
from .ranking import first_places
from .tokencount import token_counts
from .warc import round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


#: Fixed value: the text of the two turns of conversation -7, which holds the template's own signs.
TRICKY = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], own.schema)
    return digests(format_chats(canonical_turns(own.unionByName(tricky))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_grouped_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    hot = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    one = lambda c: F.when(hot, F.lit(-1)).otherwise(c).cast("long")
    whole = lambda x: F.floor(F.when(~F.isnan(x), 100 * x + 0.5)).cast("long")
    rows = lines.select(
        one(F.col("vendor_id")).alias("vendor_id"), one(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"), one(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"), whole(F.col("discount")).alias("percent"), "sale_id", F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), whole(F.col("amount")).alias("amount_cents"),
    )
    return first_places(spark, rows, ["vendor_id", "part", "month"], ["tens", "percent"], ["sale_id", "line_no", "quantity", "amount_cents"], larger_first=("tens",)).drop("tens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests/llm holds the others against libraries and brute force."""
    return {
        "op1_ngram_jaccard_join": oracle.JACCARD, "op2_embedding_near_dedup": oracle.COSINE, "op3_warc": oracle.WARC,
        "op6_chat_formatting": oracle.chat(TRICKY), "op8_quality_rules": oracle.quality(), "op12_filter_audit": oracle.AUDIT, "op13_grouped_ties": oracle.TIES,
    }

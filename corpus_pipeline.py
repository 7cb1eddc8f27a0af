"""From raw documents to packed training sequences.

Every stage but the last keeps the columns of documents: quality rules drop documents, the n-gram
Jaccard join leaves the smallest doc_id of each near-duplicate group, personal data is replaced by marks
in the text, and best-fit packing places what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.llm.common import Tables, likely, vocabulary
from marketloom.llm.jaccard import Join, jaccard_join
from marketloom.llm.packing import pack
from marketloom.llm.pii import redacted
from marketloom.llm.quality import quality_filter

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share four fifths of their five-word shingles.
NEAR = Join(words=5, top=80, bottom=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, as they are.

    Null, empty and blank texts have no words and go. Rows without an id and repeated rows are judged
    like any other; other columns than those of documents are left out.
    """
    return quality_filter(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; rows without an id, and texts without words, stay.

    Of rows that share an id and stay, equal rows become one. Texts are shuffled only where a bitmap
    says that their id may have to go or may occur twice.
    """
    own = docs.select(*COLUMNS)
    groups = Tables(spark).save(jaccard_join(spark, own, NEAR).select(F.col("doc_id").alias("id"), "component_id"), "groups")
    dropped = groups.where("id <> component_id").select("id").distinct()
    twice = groups.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    marked = likely(likely(own, "doc_id", dropped, "_dropped"), "doc_id", twice, "_twice")
    asked = marked.where("_dropped OR _twice").select(*COLUMNS).join(dropped, F.col("doc_id") == F.col("id"), "left_anti")
    return marked.where("NOT (_dropped OR _twice)").select(*COLUMNS).union(asked.dropDuplicates())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each span of personal data, and n_chars as it then is.

    Spans that overlap share one mark. Null and empty texts stay as they are, and every row stays.
    """
    return redacted(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens.

    A null or empty text is a piece of the end id alone; repeated rows and rows without an id are packed
    each. Pieces of one length take its places in the order in which tasks made them.
    """
    return pack(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", packing)]
#: SQL knows neither near-duplicate components nor tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; what the stages before it give is written and read again."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = tables.save(docs, name.replace(" ", "-"))
    return docs

"""A corpus from documents: quality, near-duplicates, benchmark leaks, mixture, token files; each stage a table.

Every stage takes documents (doc_id, text, lang, source and any other columns, which all but the last pass on) with nulls in
any column, very long texts, repeated rows and tables without rows; what becomes of these each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts are judged as empty ones, each of repeated rows for itself; without labels every text has the score 0.5
    and stays.
    """
    from dateloom.llm.quality import with_quality

    return with_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: five-word shingles, similarity of 0.8.

    Null and blank texts are near nothing and stay; of rows that repeat doc_id and text one stays.
    """
    from dateloom.llm.lsh_forest import without_near_duplicates

    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or with edits of a twentieth of its bytes.

    Null and empty texts hold nothing and stay; an empty benchmark removes nothing.
    """
    from dateloom.llm.decontaminate import without_contaminated

    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens, raked towards flatter sources, languages and topics.

    A null source or language is a value of its own; a document without words is drawn like one of its cell, with nine
    tenths where its cell has no words at all; rows that repeat a doc_id and cell go or stay together.
    """
    from dateloom.llm.mixing import Mixture, mixed

    return mixed(docs, Mixture(share=0.9)).where("sampled").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left: the place of each document in them and the crc32 of its ids.

    Null texts are empty and have the end id alone; rows without doc_id come first, repeated ones follow each other.
    """
    import public_tokenizers

    from dateloom.llm.token_files import read_tokens, write_tokens

    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Trained models and sketches are not SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm.common import spread, table
from dateloom.llm.oracle import SQL  # noqa: F401


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.lsh_forest import Forest, near_duplicates

    return near_duplicates(documents_of(spark, sf_dir), Forest(shingle=3, percent=85)).drop("text_key")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of one small file is dealt over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.decontaminate import contaminated

    return contaminated(documents_of(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.quality import quality_scores

    return quality_scores(documents_of(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.mixing import mixed

    return mixed(documents_of(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def captures_of(pages: DataFrame) -> DataFrame:
    """pages with a stand-in for the time of fetching, which the table lacks: a day of 2024 by page_id."""
    return pages.withColumn("fetched", F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(page_id % 120 as int))"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts by a fixed rule on the md5 of each: no list comes with the tables."""
    from dateloom.llm.url_filter import host_of

    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("k", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 4), 16, 10).cast("int"))
    domain = F.substring_index("host", ".", -3)
    rows = [
        ("k % 3 = 0", F.col("host"), "k % 60", "add"),
        ("k % 6 = 0", F.col("host"), "k % 60 + 20", "remove"),
        ("k % 9 = 0", F.col("host"), "k % 60 + 45", "add"),
        ("k % 7 = 0", domain, "k % 90", "add"),
        ("k % 14 = 0", domain, "k % 90 + 10", "remove"),
        ("k % 2 = 1", F.concat("host", F.lit("/en")), "k % 100", "add"),
    ]
    days = F.array(*[F.when(F.expr(test), F.struct(p.alias("pattern"), F.expr(f"make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval({day})").alias("listed"), F.lit(action).alias("action"))) for test, p, day, action in rows])
    return hosts.select(F.explode(F.array_compact(days)).alias("e")).select("e.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.url_filter import verdicts

    pages = table(spark, sf_dir, "pages")
    found = verdicts(captures_of(pages.select("page_id", "url")), entries_of(pages))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("page_id", "url", text("fetched"), "blocked", "pattern", text("valid_from"), text("valid_to"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.line_rules import cleaned

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines"]
    return cleaned(documents_of(spark, sf_dir)).select(columns)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.line_chunks import deduplicated

    found = deduplicated(documents_of(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.toxicity import toxicity_scores

    found = toxicity_scores(documents_of(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dateloom.llm.token_files import read_tokens, write_tokens

    tokens = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(tokens).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dateloom.llm.warc import digests, write_pages

    return digests(spark, write_pages(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_line_rules": op6_line_rules,
    "op7_line_chunks": op7_line_chunks,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
}

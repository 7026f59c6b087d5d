"""File sources: news tables, JSON arrays, file lists, zipped exports, feeds; predicates that reach the scan."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.functions.text import strip
from dateloom.schema import EVENT_DDL, RAW_NEWS_DDL, STAGED_DDL, backfill_events, identifier, with_optional_columns

#: Positions of the day and the URL in an export row, and the columns that it must have more than.
EXPORT_DAY, EXPORT_URL, EXPORT_COLUMNS = 1, 60, 60


def raw_news(df: DataFrame) -> DataFrame:
    """The eight columns of raw news, those that are missing as null."""
    return with_optional_columns(df, RAW_NEWS_DDL).select(*[c.split()[0] for c in RAW_NEWS_DDL.split(", ")])


def standardised(df: DataFrame) -> DataFrame:
    """Rows whose publication time is known: the filter reaches the scan."""
    return df.where(F.col("standard_timestamp").isNotNull())


def unstandardised(df: DataFrame) -> DataFrame:
    """Rows still to be standardised, so that a second run finds none of the first."""
    return df.where(F.col("standard_timestamp").isNull() & F.col("raw_time").isNotNull() & (F.col("raw_time") != ""))


def evaluable_news(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Parsed news fit for evaluation: with title and publication time; ranges and modes that older tables lack are told."""
    rows = backfill_events(with_optional_columns(df, EVENT_DDL))
    rows = rows.where((F.coalesce("title", F.lit("")) != "") & F.col("standard_timestamp").isNotNull())
    return rows.limit(limit) if limit and limit > 0 else rows


def table_named(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(identifier(name))


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, fetch: int = 5000, **options: str) -> DataFrame:
    """A database table in `parts` ranges of a numeric key; rows come `fetch` at a time."""
    return spark.read.jdbc(url, identifier(name), column=identifier(key), lowerBound=low, upperBound=high, numPartitions=parts, properties={"fetchsize": str(fetch), **options})


def json_array(spark: SparkSession, path: str, ddl: str = STAGED_DDL, required: bool = False) -> DataFrame:
    """Rows of a file that holds one JSON array; an unreadable file gives none, or ValueError if rows are required."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{_fields(ddl)}>>", {"mode": "PERMISSIVE"})).alias("r"))
    good = rows.where("r is not null").select("r.*")
    if required and good.isEmpty():
        raise ValueError(f"no rows in {path}")
    return good


def _fields(ddl: str) -> str:
    """'a int, b string' as the fields of a struct."""
    return ", ".join(":".join(c.split(None, 1)) for c in ddl.split(", "))


def data_folder(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that is there; if none is, the last, which is made."""
    conf = spark._jsc.hadoopConfiguration()
    folders = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    for path, folder in zip(paths, folders):
        if folder.getFileSystem(conf).exists(folder):
            return path
    folders[-1].getFileSystem(conf).mkdirs(folders[-1])
    return paths[-1]


def listed_exports(lines: DataFrame, first: str, last: str, column: str = "value") -> DataFrame:
    """(url, day) of the export files in lines 'size hash url' whose day, yyyyMMdd, is within first and last."""
    parts = F.split(strip(F.col(column)), r"\s+")
    url = F.when(F.size(parts) == 3, F.get(parts, 2))
    day = F.substring(F.regexp_extract(url, r"/(\d{14})\.export", 1), 1, 8)
    return lines.select(url.alias("url"), day.alias("day")).where(F.col("url").contains("export.CSV.zip") & F.col("day").between(first, last))


def export_rows(spark: SparkSession, paths: str) -> DataFrame:
    """(raw_time, url) of zipped tab-separated exports without header; archives are split over tasks and read line by line."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                days, urls = [], []
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist()[:1]:
                        with archive.open(name) as f:
                            for line in io.TextIOWrapper(f, "utf-8", "replace"):
                                cells = line.rstrip("\n").split("\t")
                                if len(cells) > EXPORT_COLUMNS:
                                    days.append(cells[EXPORT_DAY])
                                    urls.append(cells[EXPORT_URL])
                yield pd.DataFrame({"raw_time": days, "url": urls}, dtype=str)

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "raw_time string, url string")


def export_table(spark: SparkSession, path: str) -> DataFrame:
    """The same of exports that are unpacked: Spark's reader prunes all but the two columns; short rows are dropped."""
    ddl = ", ".join(f"c{i} string" for i in range(EXPORT_COLUMNS + 1))
    rows = spark.read.schema(ddl).csv(path, sep="\t", mode="DROPMALFORMED", quote="")
    return rows.select(F.col(f"c{EXPORT_DAY}").alias("raw_time"), F.col(f"c{EXPORT_URL}").alias("url")).where("url is not null")


def feed_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, position, url, title, raw_time) of the items of an RSS file, in feed order."""
    ddl = "link string, title string, pubDate string, updated string, published string"
    rows = spark.read.schema(ddl).format("xml").option("rowTag", "item").load(path)
    return rows.select(
        F.lit(source).alias("source"), F.monotonically_increasing_id().alias("position"), F.col("link").alias("url"), strip(F.col("title")).alias("title"),
        F.coalesce("pubDate", "published", "updated", F.lit("")).alias("raw_time"),
    )


def source_id(prefix: str, url: Column) -> Column:
    """A key that is the same in every run, where a random one would change when a task is run again: 128 bits of a hash, so
    that strangers never share it."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(url, 256), 1, 32))

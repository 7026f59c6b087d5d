"""Streams of feed rows: deduplicated by URL, standardised, appended without known keys, counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dateloom.functions.dates import mail_time, standard_time
from dateloom.sinks import append_new
from dateloom.sources.feeds import with_required
from dateloom.tables import small


def json_stream(spark: SparkSession, folder: str, ddl: str, files: int = 100) -> DataFrame:
    """New JSON lines files of a folder, so many a batch."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).json(folder)


def once(rows: DataFrame, late: str = "3 days", key: str = "url", raw: str = "raw_time") -> DataFrame:
    """rows without repeats of a key within the delay. Unreadable times must not be dropped as late, so the watermark runs
    on the time of arrival where there is no other."""
    arrived = F.coalesce(mail_time(F.col(raw)), standard_time(F.col(raw), strict=False, zone="UTC")).cast("timestamp")
    return rows.withColumn("_at", F.coalesce(arrived, F.current_timestamp())).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def standardised_stream(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with title and URL and their publication time on the target's clock."""
    return with_required(rows, "title", "url").withColumn("standard_timestamp", standard_time(F.col("raw_time"), strict))


def append_stream(rows: DataFrame, target: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Each batch's unknown keys appended to the Parquet table at target; a batch that is run again adds nothing twice.

    Of the target only the key column is read, and of that only the keys of the batch go on, where those are few enough to
    be broadcast.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(target)
        known = spark.read.schema(batch.schema).parquet(target) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], batch.schema)
        known = known.select(key).join(small(batch.select(key).distinct()), key, "left_semi")
        append_new(known, batch, key).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, at: str, by: str, size: str = "7 days", late: str = "3 days") -> DataFrame:
    """(window_start, window_end, by, n) in tumbling windows; rows later than the delay are left out."""
    rows = rows.withWatermark(at, late)
    counted = rows.groupBy(F.window(at, size).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")

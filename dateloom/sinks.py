"""Sinks: appends that ignore known keys, full and partial upserts, keyed updates, reports; each replaces a table as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.operators.evaluate import last_by_id


def append_new(target: DataFrame, rows: DataFrame, key: str = "url", order: list[str] | None = None) -> DataFrame:
    """The rows that an append which ignores known keys would add: one of each unknown key, the first in order."""
    rank = F.min(F.struct(*[F.col(c) for c in (order or [c for c in rows.columns if c != key])], F.struct(*[F.col(c) for c in rows.columns]).alias("_row")))
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(rank["_row"].alias("_row")).select("_row.*")
    return first.join(target.select(key).distinct(), key, "left_anti").select(rows.columns)


def appended(target: DataFrame, rows: DataFrame, key: str = "url", order: list[str] | None = None) -> DataFrame:
    """target with the rows that append_new adds."""
    return target.unionByName(append_new(target, rows, key, order), allowMissingColumns=True)


def upserted(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """target with rows put in the place of those of equal key, the last of several, and others added."""
    rows = last_by_id(rows.withColumnRenamed(key, "id")).withColumnRenamed("id", key) if key != "id" else last_by_id(rows)
    return target.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def partially_upserted(target: DataFrame, rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """target where only `columns` of rows of equal key are overwritten, also by null; rows of unknown keys are added whole."""
    every = target.columns
    source = rows.select(F.col(key).alias("_k"), *[F.col(c).alias("_" + c) for c in every if c != key and c in rows.columns], F.lit(True).alias("_there"))
    joined = target.withColumn("_old", F.lit(True)).join(source, F.col(key) == F.col("_k"), "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_k").alias(key)
        if c not in rows.columns:
            return F.col(c)
        take = F.col("_there").isNotNull() if c in columns else F.col("_old").isNull()
        return F.when(take, F.col("_" + c)).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in every])


def updated(target: DataFrame, rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """target with `columns` set where rows hold the key; nothing is added."""
    source = rows.select(F.col(key).alias("_k"), *[F.col(c).alias("_" + c) for c in columns], F.lit(True).alias("_there"))
    joined = target.join(source, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_there"), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_table(df: DataFrame, path: str) -> None:
    """df as the table at path: written beside it, then moved in one step, so a failed write leaves the old table whole."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old, at = (jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old", ""))
    files = at.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    if files.exists(at):
        files.delete(old, True)
        files.rename(at, old)
    if not files.rename(new, at):
        files.rename(old, at)
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def write_json(df: DataFrame, path: str) -> None:
    """One row a line, in one file: for reports, whose size does not grow with the data."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Files with a header; nothing is written of no rows, and False is told."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_report(folder: str, stamp: str, summary: DataFrame, by_language: DataFrame, detail: DataFrame) -> list[str]:
    """The three parts of a comparison, under names with a time stamp; those without rows are left out."""
    write_json(summary, f"{folder}/{stamp}_summary")
    parts = {"by_language": by_language, "detail": detail}
    return [f"{folder}/{stamp}_summary", *[f"{folder}/{stamp}_{name}" for name, df in parts.items() if write_csv(df, f"{folder}/{stamp}_{name}")]]

"""Stratified samples: largest-remainder allocation over strata, then the first rows of each by a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.tables import first_n


def stratum(lang: Column, parse_mode: Column, mode: str = "language_parse_mode") -> Column:
    return lang if mode == "language" else F.concat_ws("__", lang, parse_mode)


def versions_mode(v1: Column, v2: Column, on: str = "v2") -> Column:
    """The parse mode that strata of two versions are made of: v1's, v2's or both."""
    return v1 if on == "v1" else F.concat(v1, F.lit("->"), v2) if on == "both" else v2


def allocation(strata: DataFrame, size: int) -> DataFrame:
    """strata (stratum, n) with take, adding up to min(size, sum of n).

    One row of each stratum first, the largest first while they last; the rest in proportion to what is left, rounded
    down; then one more each by remainder, then key, both descending, once round. If size covers all, all are taken.
    The table of strata is small, and its windows run over that table only.
    """
    every = Window.partitionBy(F.lit(1))
    rows = strata.groupBy("stratum").agg(F.sum("n").cast("long").alias("n"))
    rows = rows.withColumns({"_all": F.sum("n").over(every), "_turn": F.row_number().over(every.orderBy(F.desc("n"), "stratum"))})
    target = F.least(F.lit(size).cast("long"), F.col("_all"))
    rows = rows.withColumn("_first", (F.col("_turn") <= target).cast("long"))
    rows = rows.withColumns({"_left": target - F.sum("_first").over(every), "_room": F.col("n") - F.col("_first")})
    rows = rows.withColumn("_rooms", F.sum("_room").over(every))
    exact = F.when((F.col("_rooms") > 0) & (F.col("_room") > 0), F.col("_left") * (F.col("_room") / F.col("_rooms"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_exact", exact)
    rows = rows.withColumn("_add", F.least(F.floor("_exact"), F.col("_room")))
    rows = rows.withColumn("_rest", F.col("_left") - F.sum("_add").over(every))
    full = (F.col("_first") + F.col("_add")) >= F.col("n")
    order = every.orderBy(full.cast("int"), F.desc(F.col("_exact") - F.col("_add")), F.desc("stratum"))
    rows = rows.withColumn("_place", F.row_number().over(order))
    extra = (~full & (F.col("_place") <= F.col("_rest"))).cast("long")
    take = F.when(F.lit(size) >= F.col("_all"), F.col("n")).otherwise(F.col("_first") + F.col("_add") + extra)
    return rows.select("stratum", "n", take.cast("long").alias("take"))


def stratified_sample(records: DataFrame, size: int, key: Column, seed: int = 42, id_column: str = "id") -> DataFrame:
    """So many rows of records, allocated over the strata that `key` names; within one by hash of id and seed, then id.

    Rows of equal hash and id are copies of each other, and any of them may be taken.
    """
    rows = records.withColumns({"_stratum": F.coalesce(key, F.lit("")), "_hash": F.xxhash64(F.col(id_column).cast("string"), F.lit(seed))})
    takes = allocation(rows.groupBy(F.col("_stratum").alias("stratum")).agg(F.count("*").alias("n")), size).select(F.col("stratum").alias("_stratum"), "take")
    rows = rows.join(F.broadcast(takes) if _few(takes) else takes, "_stratum")
    return first_n(rows, ["_stratum"], ["_hash", id_column], F.col("take")).drop("_stratum", "_hash", "take")


def _few(rows: DataFrame, most: int = 100_000) -> bool:
    return rows.limit(most + 1).count() <= most

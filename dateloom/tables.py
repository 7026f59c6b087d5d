"""Tables, the shared scratch folder, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a keyed side of a join (under 100 bytes a row) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores if it is so small that Spark would read it in fewer pieces; larger ones as they are.

    For plans that compute much of each row; the size is the plan's estimate, the files are counted in the JVM.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * (4 << 20)
    return df.repartition(cores) if few and len(df._jdf.inputFiles()) < cores else df


def tune(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches small enough that a batch of long documents fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) is a local temporary folder chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dateloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/dateloom-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage is cut and lost executors cost nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Steps(list):
    """Columns to be added step by step, written like a DataFrame's own and made once for several DataFrames: making
    thousands of expressions takes longer than planning them."""

    def withColumn(self, name: str, column: Column) -> Steps:
        return self.withColumns({name: column})

    def withColumns(self, columns: dict[str, Column]) -> Steps:
        self.append(columns)
        return self

    def added_to(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """rows with all columns added, of which those to keep stay."""
        for columns in self:
            rows = rows.withColumns(columns)
        return rows.select(*keep)


def first_n(rows: DataFrame, by: list[str], order: list, n: int | Column, salts: int = 64) -> DataFrame:
    """The first n rows of each group in an order that tells all rows of a group apart; n may be a column.

    Groups are first cut by a hash of the ordering columns: a row among the first n of its group is among the first n of
    its cut, so no group, however large, is sorted by one task.
    """
    keep = rows.columns
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for keys in ([*by, "_salt"], by):
        salted = salted.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n)
    return salted.select(keep)


def numbered(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """rows with their place in a total order: ranges are sorted by many tasks, and only a count of each meets in one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = rows.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_within") - 1 + start).drop("_part", "_within", "_before")

"""Accuracy of events against weak gold, overall and by language, and the comparison of two parser versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.operators.gold import with_flags, with_gold
from dateloom.operators.sampling import stratified_sample, stratum, versions_mode

DETAIL_TIMES = ("standard_timestamp", "event_timestamp", "event_time_start", "event_time_end")
COMPARED = {"exact": "is_exact", "relaxed": "is_relaxed", "range": "is_range_hit"}
ACCURACIES = ("exact_accuracy", "relaxed_accuracy", "range_hit_accuracy", "interval_range_hit_accuracy")


def share(part: Column, of: Column) -> Column:
    """part / of to four places; null where of is 0."""
    return F.round(F.try_divide(part, of), 4)


def metrics(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The measures of flagged rows: overall (lang null) and by language, in one aggregation over grouping sets."""
    by = ["lang"] if by is None else by
    rows = flagged.groupingSets([[], by], *by) if by else flagged.groupBy()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    good = F.col("is_interval_gold") * F.col("is_range_hit")
    counted = rows.agg(
        F.count("*").alias("sample_count"), total("is_evaluable").alias("evaluable_count"), total("is_exact").alias("exact"), total("is_relaxed").alias("relaxed"), total("is_range_hit").alias("range_hit"),
        total("is_anchor_in_gold_range").alias("anchor"), total("is_interval_gold").alias("interval_evaluable_count"), total(good).alias("interval_hit"),
    )
    n = F.col("evaluable_count")
    return counted.select(
        *by, "sample_count", "evaluable_count", F.coalesce(share(n, F.col("sample_count")), F.lit(0.0)).alias("evaluable_coverage"), share(F.col("exact"), n).alias("exact_accuracy"),
        share(F.col("relaxed"), n).alias("relaxed_accuracy"), share(F.col("range_hit"), n).alias("range_hit_accuracy"), share(F.col("anchor"), n).alias("anchor_in_gold_range_accuracy"),
        "interval_evaluable_count", share(F.col("interval_hit"), F.col("interval_evaluable_count")).alias("interval_range_hit_accuracy"),
    )


def distribution(rows: DataFrame, column: Column) -> DataFrame:
    """One row: a map from value to count, the most frequent first, then by value."""
    counted = rows.groupBy(column.alias("k")).agg(F.count("*").alias("n")).where("k is not null")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "k", "n")))
    return counted.agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["k"], x["n"]))).alias("distribution"))


def summary(flagged: DataFrame, tolerance: int = 1, mode: str = "balanced") -> DataFrame:
    """One row: the overall measures with what they were made by and how often each pattern and confidence gave the gold."""
    used = flagged.where("is_evaluable = 1")
    out = metrics(flagged, []).withColumns({"day_tolerance": F.lit(tolerance), "gold_mode": F.lit(mode)})
    out = out.crossJoin(distribution(used, F.col("gold.pattern")).withColumnRenamed("distribution", "pseudo_pattern_distribution"))
    return out.crossJoin(distribution(used, F.col("gold.confidence")).withColumnRenamed("distribution", "pseudo_confidence_distribution"))


def detail(flagged: DataFrame) -> DataFrame:
    """The rows as a report shows them: times as text, '' for none."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    plain = lambda c: F.coalesce(c, F.lit(""))
    g = F.col("gold")
    return flagged.select(
        "id", "lang", "parse_mode", "title", *[text(F.col(c)).alias(c) for c in DETAIL_TIMES], plain(F.col("time_granularity")).alias("time_granularity"),
        text(g["value"]).alias("pseudo_time"), text(g["range_start"]).alias("pseudo_range_start"), text(g["range_end"]).alias("pseudo_range_end"), plain(g["granularity"]).alias("pseudo_granularity"),
        plain(g["source_text"]).alias("pseudo_source_text"), plain(g["pattern"]).alias("pseudo_pattern"), plain(g["confidence"]).alias("pseudo_confidence"),
        "is_evaluable", "is_exact", "is_relaxed", "is_range_hit", "is_anchor_in_gold_range", "is_interval_gold",
    )


def evaluated(records: DataFrame, tolerance: int = 1, mode: str = "balanced") -> DataFrame:
    """records with gold and flags."""
    return with_flags(with_gold(records, mode), tolerance)


def sampled_evaluation(records: DataFrame, size: int = 1200, strata: str = "language_parse_mode", seed: int = 42, tolerance: int = 1, mode: str = "balanced") -> DataFrame:
    return evaluated(stratified_sample(records, size, stratum(F.col("lang"), F.col("parse_mode"), strata), seed), tolerance, mode)


def last_by_id(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each id: the last in `order`, or by all columns."""
    by = [F.desc(order)] if order else [F.desc(F.struct(*[c for c in rows.columns if c != "id"]))]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*by))).where("_n = 1").drop("_n")


def aligned(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """The ids that both versions hold: shared columns from v2 unless empty there, else v1; each one's events with _v1, _v2."""
    own = ("event_timestamp", "event_time_start", "event_time_end", "time_granularity", "parse_mode")
    shared = ("title", "standard_timestamp", "lang")
    a = last_by_id(v1).select("id", *[F.col(c).alias(c + "_v1") for c in (*own, *shared)])
    b = last_by_id(v2).select("id", *[F.col(c).alias(c + "_v2") for c in (*own, *shared)])
    rows = a.join(b, "id")
    known = F.when(F.coalesce("lang_v2", F.lit("")).isin("", "unknown"), None).otherwise(F.col("lang_v2"))
    differ = F.coalesce(F.col("standard_timestamp_v1") != F.col("standard_timestamp_v2"), F.lit(False))
    return rows.select(
        "id", F.coalesce(F.nullif("title_v2", F.lit("")), "title_v1").alias("title"), F.coalesce("standard_timestamp_v2", "standard_timestamp_v1").alias("standard_timestamp"),
        F.coalesce(known, "lang_v1").alias("lang"), differ.alias("standard_mismatch"), *[c + v for c in own for v in ("_v1", "_v2")],
    )


def version_of(rows: DataFrame, version: str, *more: str) -> DataFrame:
    """The rows of one version under the plain column names."""
    own = ("event_timestamp", "event_time_start", "event_time_end", "time_granularity", "parse_mode")
    return rows.select("id", "title", "standard_timestamp", "lang", *more, *[F.col(f"{c}_{version}").alias(c) for c in own])


def compared(rows: DataFrame, tolerance: int = 1, mode: str = "balanced", sample: int | None = None, strata: str = "language_parse_mode", on: str = "v2", seed: int = 42) -> DataFrame:
    """Aligned rows, or a stratified sample of them, with the flags of both versions and who did better by each.

    Gold depends on shared columns only and is found once for both.
    """
    if sample is not None:
        rows = stratified_sample(rows, sample, stratum(F.col("lang"), versions_mode(F.col("parse_mode_v1"), F.col("parse_mode_v2"), on), strata), seed)
    rows = with_gold(rows, mode)
    flags = ("is_evaluable", "is_exact", "is_relaxed", "is_range_hit", "is_anchor_in_gold_range", "is_interval_gold")
    for v in ("v1", "v2"):
        renamed = rows.withColumns({c: F.col(f"{c}_{v}") for c in ("event_timestamp", "event_time_start", "event_time_end")})
        rows = with_flags(renamed, tolerance).drop("event_timestamp", "event_time_start", "event_time_end").withColumnsRenamed({f: f"{f}_{v}" for f in flags})
    both = (F.col("is_evaluable_v1") == 1) & (F.col("is_evaluable_v2") == 1)
    better = lambda f: F.when(~both, "na").when(F.col(f + "_v2") > F.col(f + "_v1"), "v2_better").when(F.col(f + "_v2") < F.col(f + "_v1"), "v1_better").otherwise("tie")
    return rows.withColumns({f"{name}_compare": better(flag) for name, flag in COMPARED.items()})


def head_to_head(compared_rows: DataFrame) -> DataFrame:
    """One row for each measure: how often v2 was better, v1 was, and neither."""
    rows = compared_rows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"{name}_compare").alias("outcome")) for name in COMPARED])).alias("x")).select("x.*")
    return rows.groupBy("measure").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("v2_better", "v1_better", "tie")])


def metrics_of(compared_rows: DataFrame, version: str, by: list[str] | None = None) -> DataFrame:
    flags = ("is_evaluable", "is_exact", "is_relaxed", "is_range_hit", "is_anchor_in_gold_range", "is_interval_gold")
    return metrics(compared_rows.select("lang", *[F.col(f"{f}_{version}").alias(f) for f in flags]), by)


def language_deltas(compared_rows: DataFrame) -> DataFrame:
    """By language, and overall with lang null: counts and accuracies of both versions and v2 minus v1."""
    a, b = metrics_of(compared_rows, "v1"), metrics_of(compared_rows, "v2")
    a = a.select(F.col("lang").alias("_l"), F.col("sample_count").alias("_n"), F.col("evaluable_count").alias("evaluable_count_v1"), *[F.col(c).alias(c + "_v1") for c in ACCURACIES])
    b = b.select("lang", "sample_count", F.col("evaluable_count").alias("evaluable_count_v2"), *[F.col(c).alias(c + "_v2") for c in ACCURACIES])
    rows = a.join(b, F.col("_l").eqNullSafe(F.col("lang")), "full_outer")
    return rows.select(
        F.coalesce("lang", "_l").alias("lang"), F.coalesce("sample_count", "_n", F.lit(0)).alias("sample_count"),
        F.coalesce("evaluable_count_v1", F.lit(0)).alias("evaluable_count_v1"), F.coalesce("evaluable_count_v2", F.lit(0)).alias("evaluable_count_v2"),
        *[c + v for c in ACCURACIES for v in ("_v1", "_v2")],
        *[F.round(F.col(c + "_v2") - F.col(c + "_v1"), 4).alias(c.replace("_accuracy", "_delta_v2_minus_v1")) for c in ACCURACIES],
    )


def dataset_sizes(v1: DataFrame, v2: DataFrame, rows: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """One row: ids of either version, of both, in the sample, and how many publication times disagree."""
    ids = lambda df, name: df.agg(F.countDistinct("id").alias(name))
    mismatch = rows.agg(F.count("*").alias("overlap_count"), F.count_if("standard_mismatch").alias("standard_timestamp_mismatch_count"))
    return ids(v1, "v1_count").crossJoin(ids(v2, "v2_count")).crossJoin(mismatch).crossJoin(ids(sampled if sampled is not None else rows, "sampled_count"))


def parse_counts(rows: DataFrame, parsed: str) -> DataFrame:
    """One row: how many rows there are, how many parsed, how many did not."""
    return rows.agg(F.count("*").alias("total"), F.count(parsed).alias("parsed"), F.count_if(F.col(parsed).isNull()).alias("failed"))

"""Timelines: the text that a language model is asked with, its reply as rows, and an order that needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.functions.text import json_array_text

# --- fixed values: labels of the prompt and of replies -----------------------------------------------------------------
LABEL_ID, LABEL_TIME, LABEL_TITLE = "【事件ID】: ", "【发布时间】: ", "【新闻标题】: "
LABEL_NOISE = "【SBERT 初步判定】: 疑似噪声或衍生事件（已被初步过滤）"
LABEL_CORE, LABEL_CORE_END, UNKNOWN_CLUSTER = "【SBERT 初步判定】: 核心事件 (归属簇 ", ")", "未知"
RULE = "-" * 30
NO_TITLE, NO_TYPE, NO_REASON, NOISE_TYPE = "未知标题", "未知类型", "无解释", "无关噪声"
REPLY = "array<struct<id:string,parsed_time:string,title:string,event_type:string,reasoning:string>>"


def event_block(item: DataFrame) -> Column:
    """One event as the prompt shows it."""
    verdict = F.when(F.coalesce(F.col("system_is_noise"), F.lit(False)), F.lit(LABEL_NOISE)).otherwise(
        F.concat(F.lit(LABEL_CORE), F.coalesce(F.col("cluster_id").cast("string"), F.lit(UNKNOWN_CLUSTER)), F.lit(LABEL_CORE_END))
    )
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat(F.concat_ws("\n", line(LABEL_ID, "id"), line(LABEL_TIME, "parsed_time"), line(LABEL_TITLE, "title"), verdict, F.lit(RULE)), F.lit("\n"))


def ordered_text(rows: DataFrame, by: list[str], position: str, block: Column, name: str = "context") -> DataFrame:
    """A row for each group: its blocks one after another by position."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), block.alias("t"))))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(name))


def prompt_context(items: DataFrame, position: str = "position") -> DataFrame:
    """One row: all events (id, parsed_time, title, system_is_noise, cluster_id, position) as text."""
    return ordered_text(items, [], position, event_block(items))


def reply_rows(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(position, id, parsed_time, title, event_type, reasoning, excluded) of each step of replies, in their order.

    A reply without a readable array gives no rows. Missing types and reasons read as such; noise steps are excluded.
    """
    steps = F.from_json(json_array_text(F.col(column)), F.lit(REPLY), {"mode": "PERMISSIVE"})
    keep = [c for c in replies.columns if c != column]
    rows = replies.select(*keep, F.posexplode(steps).alias("position", "s"))
    kind = F.coalesce("s.event_type", F.lit(NO_TYPE))
    return rows.select(*keep, "position", "s.id", "s.parsed_time", "s.title", kind.alias("event_type"), F.coalesce("s.reasoning", F.lit(NO_REASON)).alias("reasoning"), (kind == NOISE_TYPE).alias("excluded"))


def titled(steps: DataFrame, news: DataFrame) -> DataFrame:
    """steps with `original_title` by id, the first of several in order of title; a placeholder for unknown ids."""
    titles = news.where("id is not null").groupBy(F.col("id").cast("string").alias("_id")).agg(F.min("title").alias("original_title"))
    out = steps.join(titles, F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    return out.withColumn("original_title", F.coalesce("original_title", F.lit(NO_TITLE)))


def timeline(items: DataFrame, model: Callable[[str], str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(position, id, parsed_time, title, event_type, reasoning) of events (id, parsed_time, title, system_is_noise, ...).

    `by` names the columns that tell one timeline from another, such as a cluster; they are passed on. With a model, its reply to the context decides. Without one this orders by time, then id: a stand-in that claims no
    causal insight. Events without a time come last.
    """
    by = by or []
    if model is not None:
        asked = ordered_text(items, by, "position", event_block(items))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields if f.name in by), "reply string"])

        def ask(batches):
            import pyarrow as pa

            for batch in batches:
                replies = [model(text) for text in batch.column("context").to_pylist()]
                yield batch.drop_columns(["context"]).append_column("reply", pa.array(replies, pa.string()))

        return reply_rows(asked.mapInArrow(ask, schema)).drop("excluded")
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = order.orderBy(F.col("parsed_time").asc_nulls_last(), "id")
    kind = F.when(F.coalesce(F.col("system_is_noise"), F.lit(False)), NOISE_TYPE).otherwise("核心事件")
    return items.select(*by, (F.row_number().over(order) - 1).alias("position"), F.col("id").cast("string").alias("id"), "parsed_time", "title", kind.alias("event_type"), F.lit("by time").alias("reasoning"))

"""Headlines made of order dates: each template states the date in one form, so plain date arithmetic predicts the event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.operators.events import extract
from dateloom.tables import spread, table

_D, _BASE = "o_orderdate", "(o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)))"
_M, _Y, _BY = "month(d)", "year(d)", "year(base)"
_INSIDE = "CASE WHEN base BETWEEN s AND e THEN base WHEN abs(date_diff('day', s, base)) <= abs(date_diff('day', e, base)) THEN s ELSE e END"

#: name: (language, title in Spark SQL over d, span start, span end, anchor, granularity in DuckDB over d and base)
TEMPLATES: dict[str, tuple[str, str, str, str, str, str]] = {
    "numeric_dmy": ("es", "concat('Encuentro del ', date_format(d, 'dd/MM/yyyy'), ' en la ciudad')", "d", "d", "d", "day"),
    "en_dmy": ("en", "concat('Report of ', day(d), ' ', date_format(d, 'MMMM yyyy'), ' reached us')", "date_trunc('month', d)", "last_day(d)", "d", "month"),
    "en_mdy": ("en", "concat('Launch on ', date_format(d, 'MMMM d, yyyy'), ' confirmed')", "d", "d", "d", "day"),
    "zh_ymd": ("zh-cn", "concat('会议', year(d), '年', month(d), '月', day(d), '日举行')", "d", "d", "d", "day"),
    "zh_md": ("zh-cn", "concat('会议', month(d), '月', day(d), '日举行')", "d", "d", "d", "day"),
    "quarter": ("en", "concat('Results Q', quarter(d), ' ', year(d), ' published')", "date_trunc('quarter', d)", "last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH)", _INSIDE, "quarter"),
    "half": ("en", "concat('Review H', if(month(d) < 7, 1, 2), ' ', year(d), ' done')", "make_date(year(d), CASE WHEN month(d) < 7 THEN 1 ELSE 7 END, 1)", "CASE WHEN month(d) < 7 THEN make_date(year(d), 6, 30) ELSE make_date(year(d), 12, 31) END", _INSIDE, "half"),
    "month_span": ("zh-cn", "concat('统计1-', month(d), '月数据')", f"make_date({_BY}, 1, 1)", f"last_day(make_date({_BY}, {_M}, 1))", _INSIDE, "month_span"),
    "quarter_prefix": ("zh-cn", "concat('前', substring('一二三四', quarter(d), 1), '季度数据')", f"make_date({_BY}, 1, 1)", f"last_day(make_date({_BY}, CAST(3 * quarter(d) AS BIGINT), 1))", _INSIDE, "quarter_span"),
    "month_only": ("zh-cn", "concat('会议', month(d), '月举行')", f"make_date({_BY}, {_M}, 1)", f"last_day(make_date({_BY}, {_M}, 1))", _INSIDE, "month"),
    "year_only": ("en", "concat('Plans in ', year(d), ' outlined')", f"make_date({_Y}, 1, 1)", f"make_date({_Y}, 12, 31)", _INSIDE, "year"),
    "relative": ("en", "'Talks held yesterday evening'", "base - INTERVAL 1 DAY", "base - INTERVAL 1 DAY", "base - INTERVAL 1 DAY", "day"),
    "weeks_ago": ("en", "'The meeting was held three weeks ago'", "base - INTERVAL 21 DAY", "base - INTERVAL 21 DAY", "base - INTERVAL 21 DAY", "day"),
    "days_ahead": ("en", "concat('Talks begin in ', 2 + day(d) % 5, ' days')", *(3 * ("base + to_days(CAST(2 + day(d) % 5 AS INT))",)), "day"),
    "weekday": ("en", "concat('Strike on ', date_format(d, 'EEEE'), ' expected')", *(3 * ("date_trunc('week', base) + to_days(CAST(isodow(d) - 1 AS INT))",)), "day"),
    "fallback": ("en", "'No dates at all in here'", "base", "base", "base", "day"),
}
#: Templates without a candidate, whose titles are read whole.
WHOLE = ("weeks_ago", "days_ahead", "weekday")

MIXED = tuple(TEMPLATES)


def rendered(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """(id, title, lang, standard_timestamp) of each order in one template, or in each by its key."""
    orders = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    base = F.col("d") + F.expr("make_dt_interval(cast(o_orderkey % 5 as int))")
    if name is not None:
        title, lang = F.expr(TEMPLATES[name][1]), F.lit(TEMPLATES[name][0])
    else:
        turn = F.col("o_orderkey") % len(MIXED)
        title = F.coalesce(*[F.when(turn == k, F.expr(TEMPLATES[n][1])) for k, n in enumerate(MIXED)])
        lang = F.coalesce(*[F.when(turn == k, F.lit(TEMPLATES[n][0])) for k, n in enumerate(MIXED)])
    return orders.select(F.col("o_orderkey").alias("id"), title.alias("title"), lang.alias("lang"), base.alias("standard_timestamp"))


def event_columns(events: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return events.select("id", text("event_timestamp"), text("event_time_start"), text("event_time_end"), "time_granularity", "parse_mode")


def event_query(name: str | None):
    return lambda spark, sf_dir: event_columns(extract(rendered(spark, sf_dir, name)))


def event_sql(name: str) -> str:
    _, _, start, end, anchor, granularity = TEMPLATES[name]
    mode = "fallback" if name == "fallback" else "tier2" if name in WHOLE else "tier1"
    day = lambda c: f"strftime({c}, '%Y-%m-%d')"
    return f"""
        SELECT id, {day("CAST(a AS DATE)")} AS event_timestamp, {day("CAST(s AS DATE)")} AS event_time_start, {day("CAST(e AS DATE)")} AS event_time_end,
               '{granularity}' AS time_granularity, '{mode}' AS parse_mode
        FROM (SELECT *, {anchor} AS a FROM (SELECT *, {start} AS s, {end} AS e
              FROM (SELECT o_orderkey AS id, CAST({_D} AS DATE) AS d, CAST({_BASE} AS DATE) AS base FROM orders)))
    """


def mixed_sql() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({event_sql(n)}) WHERE id % {len(MIXED)} = {k}" for k, n in enumerate(MIXED))

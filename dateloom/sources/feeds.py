"""News feeds: domain filters, labels, windows and checkpoints of fetching, look-back and caps, API records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.functions.dates import feed_text, feed_time, mail_time
from dateloom.functions.text import strip
from dateloom.sources.files import source_id
from dateloom.tables import first_n

# --- fixed values: domains, their sources, limits -----------------------------------------------------------------------
DOMAINS = ("aljazeera.com", "bbc.com", "dw.com", "zaobao.com", "nytimes.com", "xinhuanet.com")
SOURCES = {"Al Jazeera": "aljazeera.com", "BBC": "bbc.com", "DW": "dw.com", "The New York Times": "nytimes.com", "新华网": "xinhuanet.com", "亚洲新闻台": "channelnewsasia.com"}
STATIC_TITLE = "从URL解析或留空"
WINDOW_DAYS, LOOKBACK_DAYS, PER_SOURCE, MAX_RECORDS = 7, 3, 20, 250
FIRST_START = "2025-06-01 00:00:00"


def of_domains(url: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    """Whether one of the domains, taken as a pattern, occurs in any case: a dot fits any character. Null is no."""
    return F.coalesce(url.rlike("(?i)" + "|".join(domains)), F.lit(False))


def source_label(url: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    """The first domain that the URL literally holds, else Unknown."""
    low = F.lower(url)
    return F.coalesce(*[F.when(low.contains(d), F.lit(d)) for d in domains], F.lit("Unknown"))


def with_required(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns are neither null nor empty."""
    for c in columns or ("title", "url"):
        rows = rows.where(F.length(c) > 0)
    return rows


def export_news(rows: DataFrame) -> DataFrame:
    """Export rows (raw_time, url) of the domains as raw news with a constant title."""
    rows = rows.where(of_domains(F.col("url")))
    return rows.select(source_id("gdelt", F.col("url")).alias("id"), F.lit(STATIC_TITLE).alias("title"), "raw_time", source_label(F.col("url")).alias("source"), "url")


def api_news(replies: DataFrame, source: str, column: str = "body") -> DataFrame:
    """Articles of API replies (JSON with an array `articles`) as raw news; those without title or URL are left out."""
    kind = "struct<articles:array<struct<title:string,seendate:string,url:string>>>"
    rows = replies.select(F.explode(F.from_json(column, kind)["articles"]).alias("a"))
    rows = rows.select(source_id("gdelt", F.col("a.url")).alias("id"), F.col("a.title").alias("title"), feed_text(F.col("a.seendate")).alias("raw_time"), F.lit(source).alias("source"), F.col("a.url").alias("url"))
    return with_required(rows, "title", "url")


def search_news(replies: DataFrame, column: str = "body", source: str = "The New York Times") -> DataFrame:
    """Documents of search replies (JSON response.docs) as raw news, by the API's own key where it gives one."""
    kind = "struct<response:struct<docs:array<struct<_id:string,headline:struct<main:string>,pub_date:string,web_url:string>>>>"
    rows = replies.select(F.explode(F.from_json(column, kind)["response"]["docs"]).alias("d"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.coalesce(F.concat(F.lit("nyt_"), F.col("d._id")), source_id("nyt", text("d.web_url")))
    return rows.select(key.alias("id"), text("d.headline.main").alias("title"), text("d.pub_date").alias("raw_time"), F.lit(source).alias("source"), text("d.web_url").alias("url"))


# --- windows and checkpoints ---------------------------------------------------------------------------------------------


def fetch_windows(bounds: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(source, window_start, window_end) from bounds (source, start, stop): steps of so many days, the last one clipped;
    the next starts a second after an end. A start at or after the stop gives none."""
    step = F.expr(f"interval {days} days 1 second")
    rows = bounds.where("start < stop").withColumn("window_start", F.explode(F.sequence("start", F.expr("stop - interval 1 second"), step)))
    end = F.least(F.col("window_start") + F.expr(f"interval {days} days"), F.col("stop"))
    return rows.select("source", "window_start", end.alias("window_end"))


def next_starts(sources: DataFrame, checkpoints: DataFrame, news: DataFrame, first: str = FIRST_START) -> DataFrame:
    """(source, next_start) of each source: its checkpoint, else a second after the latest raw time among its feed rows, else
    the first start. The prefix of feed ids is a LIKE pattern, so its underscore fits any character."""
    latest = news.where(F.col("id").like("gdelt_%") & (F.coalesce("raw_time", F.lit("")) != "")).groupBy("source").agg(F.max("raw_time").alias("_raw"))
    saved = checkpoints.select("source", feed_time(F.col("next_start_time")).alias("_saved")).groupBy("source").agg(F.max("_saved").alias("_saved"))
    rows = sources.select("source").distinct().join(saved, "source", "left").join(latest, "source", "left")
    after = feed_time(F.col("_raw")) + F.expr("interval 1 second")
    return rows.select("source", F.coalesce("_saved", after, F.lit(first).cast("timestamp_ntz")).alias("next_start"))


def advanced(windows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source, next_start_time) after a run: a second after the last window before the source's first failure.

    A source whose first window failed has no row, so its checkpoint stays. outcomes: source, window_start, ok.
    """
    rows = windows.join(outcomes, ["source", "window_start"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    order = Window.partitionBy("source").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_good", F.min(F.col("ok").cast("int")).over(order)).where("_good = 1")
    last = rows.groupBy("source").agg(F.max("window_end").alias("_end"))
    return last.select("source", F.date_format(F.col("_end") + F.expr("interval 1 second"), "yyyyMMdd'T'HHmmss'Z'").alias("next_start_time"))


# --- RSS -----------------------------------------------------------------------------------------------------------------


def within_lookback(raw: Column, now: Column, days: int = LOOKBACK_DAYS) -> Column:
    """Whether an RFC 2822 date is at most so many days before now; future and unreadable dates and none are within."""
    return F.coalesce(mail_time(raw) >= now.cast("timestamp_ntz") - F.expr(f"interval {days} days"), F.lit(True))


def fresh_items(items: DataFrame, known: DataFrame, now: Column, days: int = LOOKBACK_DAYS, most: int = PER_SOURCE) -> DataFrame:
    """What a run keeps of feed items (source, position, url, title, raw_time): unknown URLs, each once, by feed order; with
    a title; within the look-back; so many of each source. known: rows with the URLs that are there already."""
    rows = items.join(known.select("url").distinct(), "url", "left_anti").where((strip(F.col("title")) != "") & within_lookback(F.col("raw_time"), now, days))
    first = Window.partitionBy("url").orderBy("source", "position")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = first_n(rows, ["source"], ["position", "url"], most)
    return rows.select(source_id("rss", F.col("url")).alias("id"), strip(F.col("title")).alias("title"), "raw_time", "source", "url", "position")

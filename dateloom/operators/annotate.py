"""The annotator path for English headlines: TIMEX annotations by rule, their values as event times, and counts of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.functions import patterns as P
from dateloom.functions.dates import integer, month_number, timex_date, timex_pick, year_near
from dateloom.functions.lang import language
from dateloom.functions.text import annotator_input, group, prefer_hint


def annotations(text: Column, published: Column) -> Column:
    """array<struct<type, value>> of a text: a small English subset of TIMEX3 in place of a full annotator.

    Dates, months, years, quarters, relative words and weeks; references to now, past and future.
    """
    hint = prefer_hint(text)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    part = lambda p, k: integer(group(text, p, k))
    mdy, my, quarter = rf"(?i)\b({P.MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+({P.YEAR}))?\b", rf"(?i)\b({P.MONTH})\s+({P.YEAR})\b", rf"(?i)\bQ([1-4])\s+({P.YEAR})\b"
    iso, year = r"\b(\d{4}-\d{2}-\d{2})\b", rf"(?i)\b(?:in|since|by|during|from|until)\s+({P.YEAR})\b"
    month, dom = month_number(group(text, mdy, 1)), part(mdy, 2)
    day_year = F.coalesce(part(mdy, 3), year_near(month, dom, published, hint))
    shifted = lambda days: F.date_format(F.date_add(published.cast("date"), days), "yyyy-MM-dd")
    week = lambda days: F.concat(F.extract(F.lit("YEAROFWEEK"), F.date_add(published.cast("date"), days)).cast("string"), F.lit("-W"), two(F.weekofyear(F.date_add(published.cast("date"), days))))
    date = lambda value: F.when(value.isNotNull(), F.struct(F.lit("DATE").alias("type"), value.alias("value")))
    said = lambda words: text.rlike(rf"(?i)\b(?:{words})\b")
    found = F.array(
        date(group(text, iso, 1)),
        date(F.concat(day_year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(dom))),
        date(F.concat(group(text, my, 2), F.lit("-"), two(month_number(group(text, my, 1))))),
        date(F.concat(group(text, quarter, 2), F.lit("-Q"), group(text, quarter, 1))),
        date(group(text, year, 1)),
        date(F.when(said("today|tonight"), shifted(0)).when(said("yesterday"), shifted(-1)).when(said("tomorrow"), shifted(1))),
        date(F.when(said("last week"), week(-7)).when(said("next week"), week(7)).when(said("this week"), week(0))),
        date(F.when(said("now|currently"), "PRESENT_REF").when(said("recently"), "PAST_REF").when(said("soon|upcoming"), "FUTURE_REF")),
    )
    return F.array_compact(found)


def annotated(news: DataFrame, annotate=annotations) -> DataFrame:
    """Adds lang, annotator_value, event_timestamp and outcome to news (title, standard_timestamp) with a publication time.

    Only English titles are annotated, first as they are sent to an annotator, without the phrase on publication that is
    added for it: that would always be found. outcome: success, empty (nothing found), error (a value that is no time), skipped.
    """
    base = F.col("standard_timestamp").cast("timestamp_ntz")
    rows = news.where("standard_timestamp is not null")
    rows = rows if "lang" in rows.columns else rows.withColumn("lang", language(F.col("title")))
    rows = rows.withColumn("annotator_input", annotator_input(F.col("title"), base))
    english = F.col("lang") == "en"
    rows = rows.withColumn("annotator_value", F.when(english, timex_pick(annotate(F.coalesce("title", F.lit("")), base))))
    rows = rows.withColumn("_at", timex_date(F.col("annotator_value"), base))
    outcome = F.when(~english, "skipped").when(F.col("_at").isNotNull(), "success").when(F.col("annotator_value").isNotNull(), "error").otherwise("empty")
    return rows.withColumns({"event_timestamp": F.coalesce("_at", base), "outcome": outcome}).drop("_at")


def outcomes(rows: DataFrame) -> DataFrame:
    """One row: how many titles succeeded, failed, held nothing, were not English, and kept the publication time."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg(count("success").alias("english_success"), count("error").alias("english_error"), count("empty").alias("english_empty"), count("skipped").alias("non_english_skipped"), F.count_if(F.col("outcome") != "success").alias("total_fallback"))

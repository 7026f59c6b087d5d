"""Date expressions on DATE columns: floors, ranges, quarters, year inference, anchors, publication times, TIMEX values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dateloom.functions import patterns as P
from dateloom.functions.text import bound, group, has, strip

SHANGHAI = "Asia/Shanghai"


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none such. Read from text, which fails without an exception: those are dear."""
    text = lambda c: c.cast("int").cast("string")
    return F.concat(F.lpad(text(year), 4, "0"), F.lit("-"), text(month), F.lit("-"), text(day)).try_cast("date")


def integer(text: Column) -> Column:
    return text.try_cast("int")


def day(t: Column) -> Column:
    return t.cast("date")


def span(start: Column, end: Column) -> Column:
    """A struct of ordered dates; null if either is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end")))


def months_of(year: Column, first: Column, last: Column) -> Column:
    """From the first day of month `first` to the last day of month `last`, in either order."""
    known = first.isNotNull() & last.isNotNull()
    return span(F.when(known, ymd(year, F.least(first, last), F.lit(1))), F.last_day(ymd(year, F.greatest(first, last), F.lit(1))))


def quarter_span(year: Column, quarter: Column) -> Column:
    return months_of(year, quarter * 3 - 2, quarter * 3)


def half_span(year: Column, half: Column) -> Column:
    return months_of(year, half * 6 - 5, half * 6)


def years_span(first: Column, last: Column) -> Column:
    return span(ymd(first, F.lit(1), F.lit(1)), ymd(last, F.lit(12), F.lit(31)))


def floor_by(t: Column, granularity: Column) -> Column:
    """t as the first day of its month or year, or as its day."""
    return F.when(granularity == "month", F.trunc(t, "month")).when(granularity == "year", F.trunc(t, "year")).otherwise(day(t))


def range_by(t: Column, granularity: Column) -> Column:
    """The day, month or year around t."""
    last = F.when(granularity == "month", F.last_day(t)).when(granularity == "year", ymd(F.year(t), F.lit(12), F.lit(31))).otherwise(day(t))
    return span(floor_by(t, granularity), last)


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a day."""
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def quarter_number(token: Column) -> Column:
    """1 to 4 from a Chinese or ASCII digit, else null."""
    number = integer(F.translate(strip(token), "一二三四", "1234"))
    return F.when(number.between(1, 4), number)


def month_number(name: Column) -> Column:
    """1 to 12 from an English month name of three letters or more."""
    return F.nullif(F.array_position(F.array(*map(F.lit, P.MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int"), F.lit(0))


def seconds_apart(date: Column, base: Column) -> Column:
    """Signed seconds from base, a time, to the start of a date."""
    clock = F.hour(base) * 3600 + F.minute(base) * 60 + F.second(base)
    return F.datediff(date, base).cast("long") * 86400 - clock


def year_near(month: Column, dom: Column, base: Column, hint: Column) -> Column:
    """The year of a month and day without one: after or before base where the hint says so and base's own year
    contradicts it by over a day, else the nearest of three years; of equally near ones base's, then the earlier."""
    here = ymd(F.year(base), month, dom)
    off = seconds_apart(here, base)
    shifted = lambda by: ymd(F.year(base) + by, month, dom)
    tries = [(0, here), (-1, shifted(-1)), (1, shifted(1))]
    ranked = [F.when(d.isNotNull(), F.struct(F.abs(seconds_apart(d, base)).alias("far"), F.lit(k).alias("turn"), F.year(d).alias("year"))) for k, (_, d) in enumerate(tries)]
    nearest = F.array_min(F.array_compact(F.array(*ranked)))["year"]
    moved = (
        F.when((hint == "future") & (off < -86400), F.coalesce(F.year(tries[2][1]), F.year(base)))
        .when((hint == "past") & (off > 86400), F.coalesce(F.year(tries[1][1]), F.year(base)))
        .otherwise(nearest)
    )
    return F.when(here.isNotNull(), moved)


def year_of_month(month: Column, base: Column, hint: Column) -> Column:
    """As year_near for the first of a month, but base's year where nothing hints at past or future."""
    return F.when(hint == "current_period", F.when(month.between(1, 12), F.year(base))).otherwise(year_near(month, F.lit(1), base, hint))


def anchor_in(s: Column, base: Column, hint: Column, words: Column) -> Column:
    """The day that stands for a span: its end after words of deadline, its start after words of beginning, base's own
    day if within, the start of a hinted future, the end of a hinted past, else the nearer end, the start if equal."""
    return anchor_of(s, base, hint, has(words, P.DEADLINE), has(words, P.BEGINNING))


def anchor_of(s: Column, base: Column, hint: Column, deadline: Column, beginning: Column) -> Column:
    """The same where it is known whether such words are there. s: best a column of its own, it is read often."""
    start, end, today = s["start"], s["end"], day(base)
    inner = (
        F.when(today.between(start, end), today)
        .when((hint == "future") & (today < start), start)
        .when((hint == "past") & (today > end), end)
        .when(F.abs(F.datediff(today, start)) <= F.abs(F.datediff(today, end)), start)
        .otherwise(end)
    )
    return F.when(s.isNull(), F.lit(None).cast("date")).when(deadline, end).when(beginning, start).otherwise(inner)


# --- publication times ----------------------------------------------------------------------------------------------


def feed_time(raw: Column) -> Column:
    """UTC time of the two compact forms that the news API writes, 20250601T000000Z and 20250601000000; else null."""
    compact = F.regexp_replace(strip(raw), r"^(\d{8})[Tt](\d{6})[Zz]$", "$1$2")
    return F.when(compact.rlike(r"^\d{14}$"), F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def feed_text(raw: Column) -> Column:
    """feed_time in the canonical form, '' if there is none."""
    return F.coalesce(F.date_format(feed_time(raw), "yyyyMMdd'T'HHmmss'Z'"), F.lit(""))


def mail_time(raw: Column) -> Column:
    """UTC time of an RFC 2822 date; null if it is none or bears no zone."""
    bare = F.regexp_replace(strip(raw), r"(?i)^[a-z]{3,9},\s*", "")
    zone = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s(?:GMT|UTC?|Z)$", " +0000"), r"\s+", " ")
    parsed = F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")))
    return F.to_utc_timestamp(parsed, F.current_timezone()).cast("timestamp_ntz")


def iso_time(raw: Column) -> Column:
    """UTC time of an ISO 8601 time with zone."""
    text = strip(raw)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"), F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))


def standard_time(raw: Column, strict: bool = True, zone: str = SHANGHAI) -> Column:
    """Wall-clock time in `zone` of a raw publication time in UTC; not strict also takes RFC 2822, ISO and bare days."""
    told = feed_time(raw)
    if not strict:
        bare = F.when(strip(raw).rlike(r"^\d{8}$"), F.try_to_timestamp(strip(raw), F.lit("yyyyMMdd")).cast("timestamp_ntz"))
        told = F.coalesce(told, mail_time(raw), iso_time(raw), bare)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), told)


def publish_text(raw: Column) -> Column:
    """The part of a scraped time line that tells the publication: after a publishing label up to a bar, else the first
    part between bars, without a leading label."""

    def told(text: Column) -> Column:
        label = F.coalesce(group(text, r"(?i)Published\s*[:\-]?\s*([^|]+)", 1), group(text, r"发布时间\s*[:：]?\s*([^|]+)", 1))
        first = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\|"), strip), lambda p: p != ""), 0), text)
        return F.coalesce(strip(label), strip(F.regexp_replace(first, r"(?i)^(?:published|last\s*updated|updated|update\s*time)\s*[:\-]?\s*", "")))

    return bound(strip(F.coalesce(raw.cast("string"), F.lit(""))), told)


_AGO = r"(?i)(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago"
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _ago(number: Column, unit: Column, anchor: Column) -> Column:
    scale = F.create_map(*[F.lit(x) for pair in _SECONDS.items() for x in pair])
    clock = anchor - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (number * F.coalesce(F.try_element_at(scale, unit), F.lit(0))).cast("decimal(18,6)"))
    return F.when(unit == "month", anchor - F.make_ym_interval(F.lit(0), number)).when(unit == "year", anchor - F.make_ym_interval(number, F.lit(0))).otherwise(clock)


def _stated(text: Column, zone: str) -> Column:
    """A date in year-first, Chinese, US or English month form with its clock, moved by a stated offset."""
    iso = r"(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
    us, word = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", rf"(?i)\b({P.MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    part = lambda pattern, k: integer(group(text, pattern, k))
    date = F.coalesce(
        ymd(part(iso, 1), part(iso, 2), part(iso, 3)),
        ymd(part(us, 3), part(us, 1), part(us, 2)),
        ymd(part(word, 3), month_number(group(text, word, 1)), part(word, 2)),
    )
    clock = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?"
    told = lambda k: F.coalesce(part(clock, k), F.lit(0))
    at = bound(date, lambda d: F.when(d.isNotNull(), F.try_make_timestamp_ntz(F.year(d), F.month(d), F.day(d), told(1), told(2), told(3))))
    offset = r"(?:GMT|UTC)\s*([+-]?\d{1,2})\b|\d{2}:\d{2}(?::\d{2})?\s*([+-]\d{2}):?\d{2}\b"
    hours = F.coalesce(part(offset, 1), part(offset, 2), F.when(has(text, r"\d{2}:\d{2}(?::\d{2})?\s*(?:Z|GMT|UTC)\b"), F.lit(0)))
    moved = lambda x: F.when(x["h"].isNotNull(), F.convert_timezone(F.lit("UTC"), F.lit(zone), x["t"] - F.make_dt_interval(F.lit(0), x["h"]))).otherwise(x["t"])
    return bound(F.struct(at.alias("t"), hours.alias("h")), moved)


def heterogeneous_time(raw: Column, anchor: Column, zone: str = SHANGHAI) -> Column:
    """Wall-clock time in `zone` of scraped times: 'N units ago' from the anchor, dates with or without clock in
    year-first, Chinese, US and English month forms, GMT offsets. A closed grammar: other forms are null."""
    parts = lambda text: F.struct(text.alias("text"), integer(group(text, _AGO, 1)).alias("n"), F.lower(group(text, _AGO, 2)).alias("unit"))
    read = lambda x: F.when(x["n"].isNotNull(), _ago(x["n"], x["unit"], anchor)).otherwise(_stated(x["text"], zone))
    return bound(bound(publish_text(raw), parts), read)


def iso_text(wall: Column, offset: str = "+08:00") -> Column:
    return F.date_format(wall, f"yyyy-MM-dd'T'HH:mm:ss'{offset}'")


# --- TIMEX values -----------------------------------------------------------------------------------------------------


def timex_pick(annotations: Column) -> Column:
    """The value of the first DATE among annotations (type, value), else the first value of any type."""
    told = F.filter(annotations, lambda a: F.coalesce(a["value"], F.lit("")) != "")
    return F.coalesce(F.get(F.filter(told, lambda a: a["type"] == "DATE"), 0)["value"], F.get(told, 0)["value"])


def timex_date(value: Column, base: Column) -> Column:
    """The time of a TIMEX value: references are base; days, months, years, quarters and ISO weeks their first day."""
    v = F.upper(strip(value))
    year = integer(F.substring(v, 1, 4))
    one = F.lit(1)
    week = integer(group(v, r"^\d{4}-W(\d{2})$", 1))
    jan4 = ymd(year, one, F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    weeks = F.datediff(F.date_sub(ymd(year + 1, one, F.lit(4)), F.weekday(ymd(year + 1, one, F.lit(4)))), monday) / 7
    found = (
        F.when(has(v, r"^\d{4}-\d{2}-\d{2}$"), ymd(year, integer(F.substring(v, 6, 2)), integer(F.substring(v, 9, 2))))
        .when(has(v, r"^\d{4}-\d{2}$"), ymd(year, integer(F.substring(v, 6, 2)), one))
        .when(has(v, r"^\d{4}$"), ymd(year, one, one))
        .when(has(v, r"^\d{4}-Q[1-4]$"), ymd(year, integer(F.substring(v, 7, 1)) * 3 - 2, one))
        .when(week.between(1, 53) & (week <= weeks), F.date_add(monday, (week - 1) * 7))
    )
    return F.when(v.isin("PRESENT_REF", "PAST_REF", "FUTURE_REF"), base.cast("timestamp_ntz")).otherwise(found.cast("timestamp_ntz"))



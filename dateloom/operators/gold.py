"""Weak gold: dates that a title states by pattern, without the parser under test; and flags that hold events against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.functions import patterns as P
from dateloom.functions.dates import day, floor_by, half_span, integer, month_number, overlap, quarter_number, quarter_span, range_by, span, year_near, years_span, ymd
from dateloom.functions.text import group, has, matches, prefer_hint
from dateloom.operators.events import grammar_point
from dateloom.tables import Steps

# --- fixed values: pattern name, pattern, granularity, confidence; the first six are all that strict mode knows -------
M, Y = P.MONTH, P.YEAR
GOLD_PATTERNS = (
    ("ymd_numeric", rf"\b{Y}[/-]\d{{1,2}}[/-]\d{{1,2}}\b", "day", "high"),
    ("zh_ymd", rf"{Y}年\d{{1,2}}月\d{{1,2}}[日号]?", "day", "high"),
    ("en_mdy", rf"\b{M}\s+\d{{1,2}},?\s+{Y}\b", "day", "high"),
    ("zh_md", r"(?<!\d)\d{1,2}月\d{1,2}[日号]?", "day", "high"),
    ("en_my", rf"\b{M}\s+{Y}\b", "month", "high"),
    ("zh_ym", rf"{Y}年\d{{1,2}}月", "month", "high"),
    ("relative_day", r"\b(?:today|yesterday|tomorrow)\b|今天|昨日|昨天|明天|后天|前天", "day", "medium"),
    ("relative_month", r"\b(?:this month|last month|next month)\b|本月|上月|下月", "month", "medium"),
    ("relative_year", r"\b(?:this year|last year|next year)\b|今年|去年|明年", "year", "medium"),
    ("zh_half", rf"(?:{Y}年)?(?:上半年|下半年)", "month", "medium"),
    ("en_half", rf"\b(?:H[12]\s+{Y}|(?:first|second)\s+half\s+of\s+{Y})\b", "month", "medium"),
    ("zh_quarter", rf"{Y}年?第?[一二三四1-4]季度", "month", "medium"),
    ("en_quarter", rf"\b(?:Q[1-4]\s+{Y}|{Y}\s+Q[1-4])\b", "month", "medium"),
    ("year_context", rf"\b(?:in|by|during|since|from)\s+{Y}\b|(?:于|在|截至|到|自){Y}年", "year", "low"),
    ("zh_month_only", r"(?:于|在|到|截至|本|上|下)?\s*\d{1,2}月(?!\d)", "month", "low"),
    ("en_month_only", rf"\b(?:in|during|for|by|this|last|next)\s+{M}\b", "month", "low"),
)
#: Patterns that strict mode knows.
STRICT = 6
SEARCH = "search_dates"
CONFIDENCE, GRANULARITY = ("high", "medium", "low"), ("day", "month", "year")
# --- fixed values: patterns whose range the pattern alone decides, cues, and what the whole-title search looks for -----
_WITHOUT_GRAMMAR = ("zh_md", "zh_half", "en_half", "zh_quarter", "en_quarter", "year_context")
AMOUNT_NEAR = rf"(?iU)[$¥￥€£₹]|USD|CNY|RMB|HKD|S\$|元|万元|亿元|万亿|美元|million|billion|trillion|\d+(?:\s*[.,]\s*\d+)?\s*%"
DAY_CUE = rf"(?iU)\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}月\d{{1,2}}[日号]?|\b{M}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|today|yesterday|tomorrow|今天|昨日|昨天|明天|后天|前天"
MONTH_CUE = rf"(?iU)\d{{4}}年\d{{1,2}}月|\d{{1,2}}月|\b{M}\b|Q[1-4]|第?[一二三四1-4]季度|上半年|下半年|this month|last month|next month|本月|上月|下月"
YEAR_CUE = r"(?iU)(?:19|20)\d{2}|this year|last year|next year|今年|去年|明年"
YEAR_PAIR = rf"(?U){Y}\s*[-/~]\s*{Y}"
SEARCHED = rf"(?iU)\b\d{{1,2}}\s+{M}\s+\d{{4}}\b|\b{M}\s+\d{{4}}\b|\b\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b|\b{Y}\b"


def amount_near(title: Column, start: Column, length: Column, reach: int = 6) -> Column:
    """Whether an amount of money or a percentage stands within a few characters of a match."""
    left = F.greatest(F.lit(0), start - reach)
    return has(F.substring(title, left + 1, start + length + reach - left), AMOUNT_NEAR)


def noisy_year(title: Column, text: Column, start: Column) -> Column:
    """Whether a year is the name of a band or part of a pair of years around it."""
    left = F.greatest(F.lit(0), start - 12)
    around = F.substring(title, left + 1, start + F.char_length(text) + 12 - left)
    band = has(text, r"(?iU)\bthe\s+1975\b") | (has(title, r"(?iU)\bthe\s+1975\b") & has(text, r"(?iU)^(?:the\s+)?1975$"))
    return (text == "") | band | (has(text, rf"^{Y}$") & has(around, YEAR_PAIR))


def gold_candidates(title: Column, mode: str = "balanced") -> Column:
    """array<struct<confidence_rank, granularity_rank, pattern_rank, start, length, ord, text, pattern, granularity,
    confidence>> in the order in which they are tried; ones near amounts are left out."""
    if mode not in ("strict", "balanced", "loose"):
        mode = "balanced"
    rules = list(GOLD_PATTERNS[: STRICT if mode == "strict" else None])
    parts = []
    for k, (name, pattern, granularity, confidence) in enumerate(rules):
        found = F.filter(matches(title, "(?iU)" + pattern), lambda m: ~amount_near(title, m["start"], F.char_length(m["text"])))
        parts.append(F.transform(found, _ranked(k, name, granularity, confidence)))
    if mode != "strict":
        parts.append(_searched(title, mode))
    return F.array_sort(F.concat(*parts))


def _ranked(k: int, name: str, granularity: str, confidence: str):
    return lambda m, i: F.struct(
        F.lit(CONFIDENCE.index(confidence)).alias("confidence_rank"), F.lit(GRANULARITY.index(granularity)).alias("granularity_rank"), F.lit(k).alias("pattern_rank"), m["start"].alias("start"),
        F.char_length(m["text"]).alias("length"), i.alias("ord"), m["text"].alias("text"), F.lit(name).alias("pattern"), F.lit(granularity).alias("granularity"), F.lit(confidence).alias("confidence"),
    )


def _searched(title: Column, mode: str) -> Column:
    """At most one candidate of the whole-title search, which stands in for a fuzzy parser."""
    confidence = "low" if mode == "balanced" else "medium"
    kind = lambda t: F.when(has(t, DAY_CUE), 0).when(has(t, MONTH_CUE), 1).when(has(t, YEAR_CUE), 2).otherwise(0)
    fit = lambda m: ~amount_near(title, m["start"], F.char_length(m["text"])) & ((kind(m["text"]) != 2) | ~noisy_year(title, m["text"], m["start"]))
    names = F.array(*map(F.lit, GRANULARITY))
    shaped = lambda m, i: F.struct(
        F.lit(CONFIDENCE.index(confidence)).alias("confidence_rank"), kind(m["text"]).alias("granularity_rank"), F.lit(len(GOLD_PATTERNS)).alias("pattern_rank"), m["start"].alias("start"),
        F.char_length(m["text"]).alias("length"), i.alias("ord"), m["text"].alias("text"), F.lit(SEARCH).alias("pattern"), F.get(names, kind(m["text"])).alias("granularity"), F.lit(confidence).alias("confidence"),
    )
    return F.transform(F.slice(F.filter(matches(title, SEARCHED), fit), 1, 1), shaped)


def gold_steps() -> Steps:
    """Adds gold (struct<value, range_start, range_end, granularity, source_text, pattern, confidence>) to rows (c, base, hint, lang);
    null where the candidate c does not parse."""
    rows = Steps()
    text, pattern = F.col("c.text"), F.col("c.pattern")
    base, hint, lang = F.col("base"), F.col("hint"), F.col("lang")
    part = lambda p, k: integer(group(text, p, k))
    month_day = r"(?U)(?<!\d)(\d{1,2})月(\d{1,2})[日号]?"
    zh_half, en_half, half_words = rf"(?:({Y})年)?([上下])半年", rf"(?i)H([12])\s+({Y})", rf"(?i)(first|second)\s+half\s+of\s+({Y})"
    zh_quarter, en_quarter, quarter_last = rf"({Y})年?第?([一二三四1-4])季度", rf"(?i)Q([1-4])\s+({Y})", rf"(?i)({Y})\s+Q([1-4])"
    day_year = year_near(part(month_day, 1), part(month_day, 2), base, hint)
    rows = rows.withColumn("_md_year", day_year)
    md = ymd(F.col("_md_year"), part(month_day, 1), part(month_day, 2))
    full = r"(?U)(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
    word = rf"(?iU)\b({M})\s+(\d{{1,2}}),?\s+({Y})\b"
    stated = F.coalesce(ymd(part(full, 1), part(full, 2), part(full, 3)), ymd(part(word, 3), month_number(group(text, word, 1)), part(word, 2)))
    bare_month = part(r"(?U)(\d{1,2})月(?!\d)", 1)
    zh_month = F.when(pattern == "zh_month_only", ymd(F.coalesce(F.when(hint == "current_period", F.year(base)), year_near(bare_month, F.lit(1), base, hint)), bare_month, F.lit(1)))
    rows = rows.withColumns({"_stated": F.when(pattern.isin("ymd_numeric", "zh_ymd", "en_mdy"), stated), "_grammar": F.coalesce(zh_month, F.when(F.coalesce(~pattern.isin(*_WITHOUT_GRAMMAR), F.lit(False)), grammar_point(text, base, hint, lang)))})
    fuzzy = F.coalesce(F.col("_stated"), F.col("_grammar"))
    fuzzy = F.when(F.year(fuzzy).between(1900, 2100), floor_by(fuzzy, F.col("c.granularity")))
    year = part(Y.replace("(?:", "(", 1), 1)
    rows = rows.withColumn("_fuzzy", fuzzy)
    found = (
        F.when(pattern == "zh_md", span(md, md))
        .when(pattern == "zh_half", half_span(F.coalesce(part(zh_half, 1), F.year(base)), F.when(group(text, zh_half, 2) == "上", 1).otherwise(2)))
        .when(pattern == "en_half", F.coalesce(half_span(part(en_half, 2), part(en_half, 1)), half_span(part(half_words, 2), F.when(F.lower(group(text, half_words, 1)) == "first", 1).otherwise(2))))
        .when(pattern == "zh_quarter", quarter_span(part(zh_quarter, 1), quarter_number(group(text, zh_quarter, 2))))
        .when(pattern == "en_quarter", F.coalesce(quarter_span(part(en_quarter, 2), part(en_quarter, 1)), quarter_span(part(quarter_last, 1), part(quarter_last, 2))))
        .when(pattern == "year_context", years_span(year, year))
        .otherwise(range_by(F.col("_fuzzy"), F.col("c.granularity")))
    )
    rows = rows.withColumn("_range", found)
    value = F.coalesce(F.when(F.col("_fuzzy").isNotNull() & ~pattern.isin(*_WITHOUT_GRAMMAR), F.col("_fuzzy")), F.col("_range.start"))
    stamp = lambda c: c.cast("timestamp_ntz")
    gold = F.struct(stamp(value).alias("value"), stamp(F.col("_range.start")).alias("range_start"), stamp(F.col("_range.end")).alias("range_end"), F.col("c.granularity").alias("granularity"), text.alias("source_text"), pattern.alias("pattern"), F.col("c.confidence").alias("confidence"))
    return rows.withColumn("gold", F.when(F.col("_range").isNotNull(), gold))


def with_gold(records: DataFrame, mode: str = "balanced") -> DataFrame:
    """Adds gold to records (id, title, standard_timestamp, lang, ...): the first candidate, in order, that parses.

    Every row comes back, repeated ones too; the first candidate is read beside its row, others only where it does not parse.
    """
    keep = [c for c in records.columns if c != "gold"]
    base = F.col("standard_timestamp").cast("timestamp_ntz")
    title = F.coalesce("title", F.lit(""))
    rows = records.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_kept"), base.alias("base"), prefer_hint(title).alias("hint"), "lang", F.when((title != "") & base.isNotNull() & title.rlike(P.MAY_HOLD), gold_candidates(title, mode)).alias("_all"))
    steps = gold_steps()
    rows = steps.added_to(rows.withColumn("c", F.get("_all", 0)), ["_row", "_kept", "base", "hint", "lang", "_all", F.col("gold").alias("_gold")])
    rest = F.when(F.col("_gold").isNull() & (F.size("_all") > 1), F.slice("_all", 2, F.size("_all")))
    rows = steps.added_to(rows.withColumn("c", F.explode_outer(rest)).drop("_all"), ["_row", "_kept", "_gold", "c", "gold"])
    gold = F.coalesce("_gold", "gold")
    rank = F.struct(F.col("_gold").isNull(), *[F.col("c." + n) for n in ("confidence_rank", "granularity_rank", "pattern_rank", "start", "length", "ord")])
    return rows.groupBy("_row").agg(F.first("_kept").alias("_kept"), F.min_by(gold, F.when(gold.isNotNull(), rank)).alias("gold")).select("_kept.*", "gold")


def same_by_granularity(event: Column, value: Column, granularity: Column) -> Column:
    """Whether both fall on the same day, month or year."""
    return (
        F.when(granularity == "day", day(event) == day(value))
        .when(granularity == "month", F.trunc(event, "month") == F.trunc(value, "month"))
        .when(granularity == "year", F.year(event) == F.year(value))
        .otherwise(False)
    )


def within_days(event: Column, value: Column, granularity: Column, most: int) -> Column:
    """Whether they are at most so many days apart; months and years must be the same."""
    return F.when(granularity == "day", F.abs(F.datediff(event, value)) <= most).otherwise(same_by_granularity(event, value, granularity))


def with_flags(records: DataFrame, tolerance: int = 1) -> DataFrame:
    """Adds is_evaluable, is_exact, is_relaxed, is_range_hit, is_anchor_in_gold_range and is_interval_gold (0 or 1)."""
    event, gold = F.col("event_timestamp"), F.col("gold")
    records = records.withColumns(
        {
            "_own": span(day(F.coalesce("event_time_start", event)), day(F.coalesce("event_time_end", event))),
            "_gold": span(day(gold["range_start"]), day(gold["range_end"])),
            "_ok": gold.isNotNull() & event.isNotNull(),
        }
    )
    flag = lambda test: F.coalesce((F.col("_ok") & test).cast("int"), F.lit(0))
    return records.withColumns(
        {
            "is_evaluable": F.col("_ok").cast("int"),
            "is_exact": flag(same_by_granularity(event, gold["value"], gold["granularity"])),
            "is_relaxed": flag(within_days(event, gold["value"], gold["granularity"], tolerance)),
            "is_range_hit": flag(overlap(F.col("_own"), F.col("_gold"))),
            "is_anchor_in_gold_range": flag(day(event).between(F.col("_gold.start"), F.col("_gold.end"))),
            "is_interval_gold": flag(F.col("_gold.start") != F.col("_gold.end")),
        }
    ).drop("_own", "_gold", "_ok")

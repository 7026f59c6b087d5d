"""Event time of headlines: candidates, ranks, points, spans, and the three tiers that choose among them.

The best ranked candidate of a title is read first, in flat columns beside the title; only where it does not parse are the
others, and at last the whole title, exploded and read. One aggregation on a key of the row takes the best of
these; its partial sums run before the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.functions import patterns as P
from dateloom.functions.dates import (
    anchor_of,
    day,
    integer,
    month_number,
    months_of,
    quarter_number,
    range_by,
    span,
    year_near,
    year_of_month,
    years_span,
    ymd,
)
from dateloom.functions.lang import language
from dateloom.functions.text import ascii_width, bound, group, has, matches, prefer_hint
from dateloom.tables import Steps

_CANDIDATE = "array<struct<text:string,start:int,ord:int>>"


# --- candidates -------------------------------------------------------------------------------------------------------


def _numbered(first: int):
    return lambda m, i: F.struct(m["text"].alias("text"), m["start"].alias("start"), (F.lit(first) + i).alias("ord"))


def candidates(title: Column, lang: Column, tagged: Column | None = None) -> Column:
    """array<struct<text, start, ord>>: what the patterns for the language find in the normalised title, after the spans
    of an entity tagger (array of text and start), if there is one; of equal text without spaces and start the first."""
    zh, en = F.coalesce(lang.startswith("zh"), F.lit(False)), F.coalesce(lang == "en", F.lit(False))
    empty = F.array().cast(_CANDIDATE)

    def of(norm: Column) -> Column:
        parts = []
        for k, (marks, pattern) in enumerate(P.CANDIDATES, 1):
            found = F.transform(matches(norm, "(?iU)" + pattern), _numbered(1000 * k))
            wanted = ~(zh | en) | (zh if "z" in marks else F.lit(False)) | (en if "e" in marks else F.lit(False))
            parts.append(F.when(wanted, found.cast(_CANDIDATE)).otherwise(empty))
        if tagged is not None:
            own = F.transform(tagged, lambda m, i: F.struct(ascii_width(m["text"]).alias("text"), m["start"].cast("int").alias("start"), i.alias("ord")))
            parts.insert(0, F.coalesce(own.cast(_CANDIDATE), empty))
        return F.concat(*parts)

    return bound(ascii_width(title), of)


def distinct_candidates(found: Column) -> Column:
    """The candidates without those that repeat the text, but for spaces, and start of an earlier one."""
    key = lambda c: F.concat_ws("@", F.regexp_replace(c["text"], r"(?U)\s+", ""), c["start"].cast("string"))
    first = lambda some: bound(F.transform(some, key), lambda keys: F.filter(some, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    # both are bound: the search for candidates would else run again for each of them
    return bound(found, first)


def is_noise(text: Column) -> Column:
    """Whether a candidate is no date: empty, an ordinal of a session, an amount, or a number that is no year."""
    norm = ascii_width(text)
    return _noise(norm, F.regexp_replace(norm, r"(?U)\s+", ""))


def _noise(norm: Column, bare: Column) -> Column:
    """is_noise of a normalised text, and the text without spaces."""
    full = has(norm, r"(?U)\b\d{4}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{1,2}\b") | has(norm, P.NUMERIC_DMY) | has(norm, P.SCORES[2][1])
    number = has(bare, r"(?U)^\d+(?:[.,]\d+)*$")
    value = F.regexp_replace(bare, ",", "").try_cast("double")
    year = F.coalesce(F.floor(value).between(1900, 2100), F.lit(False))
    amount = ~has(norm, P.DATE_SIGNAL) & (has(norm, P.PERCENT) | has(norm, P.MONEY))
    return (bare == "") | (~full & (has(bare, r"(?U)^第[一二三四五六七八九十百千万\d]+届$") | amount | (number & ~year)))


def is_source_tail(title: Column, start: Column) -> Column:
    """Whether a date late in the title follows an outlet's name and a dash."""
    before = F.substring(title, F.greatest(F.lit(1), start - 23), F.least(F.lit(24), start))
    late = start >= F.floor(F.char_length(title) * 0.6)
    return late & ((has(before, P.OUTLETS) & has(before, r"[-–—|]")) | has(before, P.OUTLET_BEFORE_DASH))


def score(text: Column, start: Column, title: Column) -> Column:
    """The rank of a candidate: what it looks like, less what speaks against it, less its distance from the front."""
    return bound(ascii_width(text), lambda norm: _score(norm, start, title))


def _score(norm: Column, start: Column, title: Column) -> Column:
    looks = F.lit(None).cast("int")
    for points, pattern in reversed(P.SCORES):
        looks = F.when(has(norm, pattern), points).otherwise(looks)
    prior = (start > 0) & has(F.substring(title, F.lit(1), F.greatest(F.lit(0), start - 1)), P.PRIOR_SIGNAL)
    noise = bound(F.regexp_replace(norm, r"(?U)\s+", ""), lambda bare: _noise(norm, bare))
    minus = (
        F.when(F.lower(norm) == "may", 40).otherwise(0)
        + F.when(has(norm, r"(?iU)\bthe\s+1975\b"), 40).otherwise(0)
        + F.when(noise, 100).otherwise(0)
        + F.when(is_source_tail(title, start), F.when(prior, 45).otherwise(18)).otherwise(0)
        + F.floor(F.least(start, F.lit(100)) / 20).cast("int")
    )
    return F.coalesce(looks, F.lit(0)) + F.when(has(norm, P.FUTURE) | has(norm, P.PAST), 10).otherwise(0) - minus


# --- spans and points -------------------------------------------------------------------------------------------------


def span_parts(text: Column) -> dict[str, Column]:
    """struct<year, first, last> (months; year null where none is said) for each pattern of P.SPANS, null where it does not occur."""
    number = lambda name, k: integer(group(text, P.SPANS[name], k))
    word = lambda name, k: F.lower(group(text, P.SPANS[name], k))
    one = F.lit(1)

    def part(year: Column, first: Column, last: Column) -> Column:
        valid = first.between(1, 12) & last.between(1, 12)
        return F.when(valid, F.struct(year.alias("year"), first.alias("first"), last.alias("last")))

    quarter = lambda year, q: part(year, q * 3 - 2, q * 3)
    half = lambda year, second: part(year, F.when(second, 7).otherwise(1), F.when(second, 12).otherwise(6))
    half_word = word("half_words", 1)
    return {
        "month_span": part(number("month_span", 1), number("month_span", 2), number("month_span", 3)),
        "month_prefix": part(number("month_prefix", 1), one, number("month_prefix", 2)),
        "quarter_prefix": part(number("quarter_prefix", 1), one, quarter_number(word("quarter_prefix", 2)) * 3),
        "quarter_zh": quarter(number("quarter_zh", 1), quarter_number(word("quarter_zh", 2))),
        "quarter_en": quarter(number("quarter_en", 2), number("quarter_en", 1)),
        "quarter_year_first": quarter(number("quarter_year_first", 1), number("quarter_year_first", 2)),
        "half_zh": F.when(has(text, P.SPANS["half_zh"]), half(number("half_zh", 1), word("half_zh", 2) == "下")),
        "half_en": F.when(has(text, P.SPANS["half_en"]), half(number("half_en", 2), word("half_en", 1) == "2")),
        "half_words": F.when(half_word.isNotNull(), half(number("half_words", 2), half_word == "second")),
    }


def dated(part: Column, year: Column) -> Column:
    """The span of a part in its own year, or in `year`."""
    return months_of(F.coalesce(part["year"], year), part["first"], part["last"])


#: Spans in the order in which a range is told from a candidate, with their granularity.
_ORDER = (
    ("month_span", "month_span"), ("month_prefix", "month_span"), ("quarter_prefix", "quarter_span"), ("quarter_zh", "quarter"), ("quarter_en", "quarter"),
    ("quarter_year_first", "quarter"), ("half_zh", "half"), ("half_en", "half"), ("half_words", "half"),
)


#: Spans that are written in Chinese and do not say so in their names.
_CHINESE = ("month_span", "month_prefix", "quarter_prefix")


def _tagged(s: Column, granularity: Column) -> Column:
    return F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"), granularity.alias("granularity")))


def _two_digit_end(text: Column) -> tuple[Column, Column]:
    """First and last year of a pair; a last year of two digits is the next such year."""
    first, last = integer(group(text, P.YEARS, 1)), group(text, P.YEARS, 2)
    short = F.floor(first / 100) * 100 + integer(last)
    return first, F.when(F.char_length(last) == 2, F.when(short < first, short + 100).otherwise(short)).otherwise(integer(last)).cast("int")


def with_span(rows: Steps, point: str, text: str, corrected: bool = False) -> Steps:
    """Adds _span, struct<start, end, granularity>: what a candidate means around its point, by ordered rules; a day if
    none fits. rows have the columns of span_parts under their names with _p_ before.

    corrected tests full dates before years and months; the plain order takes 2025-03-18 for the years 2025 to 2103.
    """
    t, at = F.col(text), F.col(point)
    named = F.coalesce(*[F.when(F.col("_p_" + name).isNotNull(), F.struct(F.col("_p_" + name).alias("part"), F.lit(kind).alias("kind"))) for name, kind in _ORDER])
    rows = rows.withColumn("_named", named)
    first, last = _two_digit_end(t)
    months = has(t, r"(?U)\d{1,2}\s*(?:/|-|~|到|至)\s*\d{1,2}月")
    zh_year, zh_month = integer(group(t, P.ZH_YM, 1)), integer(group(t, P.ZH_YM, 2))
    en_year, en_month = integer(group(t, P.EN_MY, 2)), month_number(group(t, P.EN_MY, 1))
    year_only = has(t, rf"(?U)^(?:于|在|截至|到|自|至)?\s*{P.YEAR}年?$") | has(t, P.YEAR_AFTER_WORD)
    said = integer(group(t, P.YEAR, 0))
    finer = has(t, r"(?U)\d{1,2}\s*[-/.]\s*\d{1,2}") | has(t, r"(?U)\d{1,2}月")
    rows = rows.withColumns(
        {
            "_r_named": dated(F.col("_named.part"), F.year(at)),
            "_r_years": F.when(~months, years_span(first, last)),
            "_r_month": F.coalesce(months_of(zh_year, zh_month, zh_month), F.when(~has(t, P.EN_MY_WITH_DAY), months_of(en_year, en_month, en_month)), F.when(has(t, P.MONTH_AFTER_WORD) | has(t, P.SINGLE_ZH_MONTH), range_by(at, F.lit("month")))),
            "_r_year": F.when(year_only & ~finer, years_span(said, said)),
            "_r_day": span(at, at),
        }
    )
    rules = [_tagged(F.col("_r_named"), F.col("_named.kind")), *[_tagged(F.col("_r_" + name), F.lit(kind)) for name, kind in (("years", "year_span"), ("month", "month"), ("year", "year"), ("day", "day"))]]
    if corrected:
        full = has(t, P.FULL_DATE) | has(t, P.NUMERIC_DMY) | has(t, P.EN_DMY)
        rules.insert(0, F.when(full, rules[-1]))
    return rows.withColumn("_span", F.when(at.isNotNull(), F.coalesce(*rules)))


def says_year(text: Column) -> Column:
    return has(text, r"(?:19|20)\d{2}") | text.contains("年")


def supports_far_year(text: Column) -> Column:
    """Whether words for a year, a month or a day stand with it."""
    dated = has(text, r"(?U)\d{1,2}\s*[-/.]\s*\d{1,2}") | has(text, r"(?U)\d{1,2}月") | has(text, rf"(?iU)\b{P.MONTH}\b")
    return dated | has(text, P.YEAR_CONTEXT)


def is_plausible(point: Column, base: Column, explicit: Column, supported: Column) -> Column:
    """Whether a point may be meant: 1900 to 2100; near base unless a year is said, and even then unless words support it."""
    far = F.abs(F.year(point) - F.year(base))
    return F.coalesce(F.year(point).between(1900, 2100) & F.when(explicit, (far <= 4) | supported).otherwise(far <= 2), F.lit(False))


def numeric_point(text: Column, lang: Column) -> Column:
    """Day, month and year in figures; which is the month is told by size, then by language."""
    a, b, year = (integer(group(text, P.NUMERIC_DMY, k)) for k in (1, 2, 3))
    month_first = (a <= 12) & ((b > 12) | F.coalesce(lang == "en", F.lit(False)))
    return F.when(month_first, ymd(year, a, b)).otherwise(ymd(year, b, a))


def bare_year(text: Column, base: Column) -> Column:
    """The span of a bare year or pair of years near base or with a word for it; null where finer dates are said."""
    finer = has(text, r"(?U)\d{1,2}\s*[-/.]\s*\d{1,2}") | has(text, rf"(?iU)\b{P.MONTH}\b") | has(text, r"(?U)\d{1,2}月") | has(text, P.QUARTER_OR_HALF)
    year = integer(group(text, rf"(?U)(?<!\d)({P.YEAR})(?!\d)", 1))
    near = (F.abs(year - F.year(base)) <= 4) | has(text, P.YEAR_CONTEXT)
    return F.when(~finer & near, years_span(year, year))


def _shift(words: dict[str, int], word: Column) -> Column:
    """How far a relative word moves; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), word)


def relative_point(text: Column, base: Column) -> Column:
    """Days that a title tells from the day of publication: 'in three weeks', 'two days ago', 'next Friday', 'on Monday'.

    A weekday alone or after this is that day of the week of publication (from Monday), after last or next the nearest
    one before or after. Months and years keep the day where there is such a day.
    """
    today = day(base)
    number = lambda word: F.coalesce(integer(word), _shift(P.NUMBERS, F.lower(word)))
    ago, ahead = (number(group(text, p, 1)) for p in (P.AGO, P.AHEAD))
    n = F.coalesce(-ago, ahead)
    unit = F.lower(F.coalesce(group(text, P.AGO, 2), group(text, P.AHEAD, 2)))
    moved = F.when(unit == "day", F.date_add(today, n)).when(unit == "week", F.date_add(today, 7 * n)).when(unit == "month", F.add_months(today, n)).when(unit == "year", F.add_months(today, 12 * n))
    word, which = F.lower(group(text, P.WEEKDAY, 2)), F.lower(group(text, P.WEEKDAY, 1))
    wanted = _shift({w: k for k, w in enumerate(P.WEEKDAYS)}, F.substring(word, 1, 3))
    off = wanted - F.weekday(today)
    off = F.when(which == "last", F.when(off < 0, off).otherwise(off - 7)).when(which == "next", F.when(off > 0, off).otherwise(off + 7)).otherwise(off)
    return F.coalesce(F.when(n <= 5_000, moved), F.date_add(today, off))


def grammar_point(text: Column, base: Column, hint: Column, lang: Column) -> Column:
    """A closed grammar in place of a fuzzy parser: year-first dates, month and year, a month after a preposition,
    relative words, weekdays, numbers of days, weeks, months or years ago or ahead, and day and month names of other
    languages. Anything else is null."""
    numeric = r"(?U)\b(\d{4})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})\b"
    part = lambda pattern, k: integer(group(text, pattern, k))
    one = F.lit(1)
    after = month_number(group(text, P.MONTH_AFTER_WORD, 1))
    month_year = rf"(?iU)\b({P.MONTH})\s+(\d{{4}})\b"
    zh_year_month = r"(?U)(\d{4})年(\d{1,2})月"
    today, word = day(base), F.lower(text)
    tries = [
        ymd(part(numeric, 1), part(numeric, 2), part(numeric, 3)),
        ymd(part(month_year, 2), month_number(group(text, month_year, 1)), one),
        ymd(part(zh_year_month, 1), part(zh_year_month, 2), one),
        ymd(year_of_month(after, base, hint), after, one),
        ymd(part(r"(?U)^(\d{4})年?$", 1), F.month(base), one),
        F.date_add(today, _shift(P.RELATIVE_DAYS, word)),
        F.add_months(today, _shift(P.RELATIVE_MONTHS, word)),
        F.add_months(today, 12 * _shift(P.RELATIVE_YEARS, word)),
        F.when(has(text, P.RELATIVE), relative_point(text, base)),
    ]
    for code, names in P.MONTHS_ABROAD.items():
        pattern = rf"(?iU)\b(\d{{1,2}})\s+(?:de\s+)?({'|'.join(names)})(?:\s+(?:de\s+|del\s+)?(\d{{4}}))?\b"
        month = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(group(text, pattern, 2))).cast("int"), F.lit(0))
        dom = part(pattern, 1)
        tries.append(F.when(lang == code, ymd(F.coalesce(part(pattern, 3), year_near(month, dom, base, hint)), month, dom)))
    korean = r"(?:(\d{4})년\s*)?(\d{1,2})월\s*(\d{1,2})일"
    tries.append(F.when(text.contains("월"), ymd(F.coalesce(part(korean, 1), year_near(part(korean, 2), part(korean, 3), base, hint)), part(korean, 2), part(korean, 3))))
    return F.coalesce(*tries)


def snap_span(point: Column, text: Column) -> Column:
    """The year or month around a grammar point that its text names; null where it names a day."""
    month_said = has(text, P.ZH_YM) | (has(text, rf"(?iU)\b{P.MONTH}\s+\d{{4}}\b") & ~has(text, rf"(?iU)\b{P.MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b")) | has(text, P.MONTH_AFTER_WORD) | has(text, P.SINGLE_ZH_MONTH)
    kind = F.when(has(text, r"(?U)^\d{4}年?$") | has(text, P.YEAR_AFTER_WORD), "year").when(month_said, "month")
    return F.when(kind.isNotNull(), range_by(point, kind))


def parsed(rows: DataFrame, corrected: bool = False, steps: Steps | None = None) -> DataFrame:
    """Adds event (see parse_steps, which may be made before) to rows (text, base, lang, hint); an event that is there is replaced."""
    return (steps or parse_steps(corrected)).added_to(rows, [*(c for c in rows.columns if c != "event"), "event"])


def parse_steps(corrected: bool = False) -> Steps:
    """Adds event (struct<anchor, start, end, granularity, candidate_text>) to rows (text, base, lang, hint).

    The first reading of the text that is plausible gives its point; a Chinese month and day that is not plausible ends
    the search. The point is kept as anchor if it lies in the span that the text means, else the span's own anchor is.
    Each step adds flat columns that the next ones read, so that no expression is repeated.
    """
    rows = Steps()
    text, base, hint, lang = (F.col(c) for c in ("_text", "base", "hint", "lang"))
    zh, latin = F.col("_zh"), F.col("_latin")
    # a null text stays null, so that no pattern is tried on rows that are settled
    rows = rows.withColumn("_text", F.when(F.col("text").isNotNull(), ascii_width(F.col("text"))))
    # what every step asks of the text is asked once; patterns of a script are tried only where it occurs
    rows = rows.withColumns(
        {
            "_zh": has(text, "[年月季半]"), "_latin": has(text, "[A-Za-z]"), "_deadline": has(text, P.DEADLINE), "_beginning": has(text, P.BEGINNING),
            "_explicit": says_year(text), "_supported": supports_far_year(text), "_noise": is_noise(text),
        }
    )
    part = lambda pattern, k: integer(group(text, pattern, k))
    rows = rows.withColumns({"_p_" + name: F.when(zh if "zh" in name or name in _CHINESE else latin, x) for name, x in span_parts(text).items()})
    rows = rows.withColumns(
        {
            "_zh_month": F.when(zh, part(P.ZH_MD, 2)), "_zh_day": F.when(zh, part(P.ZH_MD, 3)), "_en_month": F.when(latin, month_number(group(text, P.EN_MDY, 1))),
            "_en_day": F.when(latin, part(P.EN_MDY, 2)), "_only": F.when(zh, part(P.SINGLE_ZH_MONTH, 1)),
        }
    )
    rows = rows.withColumns(
        {
            "_zh_year": F.when(F.col("_zh_day").isNotNull(), F.coalesce(part(P.ZH_MD, 1), year_near(F.col("_zh_month"), F.col("_zh_day"), base, hint))),
            "_en_year": F.when(F.col("_en_day").isNotNull(), F.coalesce(part(P.EN_MDY, 3), year_near(F.col("_en_month"), F.col("_en_day"), base, hint))),
            "_only_year": F.when(F.col("_only").isNotNull(), year_of_month(F.col("_only"), base, hint)),
        }
    )
    one_of = lambda *names: F.coalesce(*[F.col("_p_" + n) for n in names])
    spans = {
        "prefix": dated(F.col("_p_quarter_prefix"), F.year(base)),
        "months": dated(one_of("month_span", "month_prefix"), F.year(base)),
        "month": months_of(F.col("_only_year"), F.col("_only"), F.col("_only")),
        "part": dated(one_of("quarter_en", "quarter_year_first", "quarter_zh", "half_zh", "half_en", "half_words"), F.year(base)),
        "year": bare_year(text, base),
    }
    rows = rows.withColumns({"_s_" + name: s for name, s in spans.items()})
    anchored = lambda s: anchor_of(s, base, hint, F.col("_deadline"), F.col("_beginning"))
    points = {
        "_a_numeric": numeric_point(text, lang),
        "_a_dmy": F.when(latin, ymd(part(P.EN_DMY, 3), month_number(group(text, P.EN_DMY, 2)), part(P.EN_DMY, 1))),
        "_a_zh": ymd(F.col("_zh_year"), F.col("_zh_month"), F.col("_zh_day")),
        "_a_mdy": ymd(F.col("_en_year"), F.col("_en_month"), F.col("_en_day")),
    }
    rows = rows.withColumns({"_a_" + name: anchored(F.col("_s_" + name)) for name in spans} | points)
    order = ("numeric", "dmy", "zh", "prefix", "months", "mdy", "month", "part", "year")
    plausible = lambda c: F.when(is_plausible(F.col(c), base, F.col("_explicit"), F.col("_supported")), F.col(c))
    ok = [plausible("_a_" + name) for name in order]
    rows = rows.withColumn("_early", F.coalesce(ok[0], ok[1], F.when(F.col("_a_zh").isNotNull(), ok[2]).otherwise(F.coalesce(*ok[3:]))))
    # the grammar reads only what nothing before it has settled
    open_ = F.col("_early").isNull() & F.col("_a_zh").isNull() & ~F.col("_noise") & base.isNotNull()
    rows = rows.withColumn("_grammar", F.when(open_, grammar_point(text, base, hint, lang)))
    rows = rows.withColumn("_s_snap", F.when(F.col("_grammar").isNotNull(), snap_span(F.col("_grammar"), text)))
    rows = rows.withColumn("_a_snap", F.when(F.col("_grammar").isNotNull(), F.coalesce(anchored(F.col("_s_snap")), F.col("_grammar"))))
    point = F.coalesce(F.col("_early"), plausible("_a_snap"))
    rows = rows.withColumn("_point", F.when(~F.col("_noise") & (F.lower(text) != "may") & base.isNotNull(), point))
    rows = with_span(rows, "_point", "_text", corrected)
    rows = rows.withColumn("_anchor", F.when(F.col("_point").between(F.col("_span.start"), F.col("_span.end")), F.col("_point")).otherwise(anchored(F.col("_span"))))
    event = F.struct(F.col("_anchor").alias("anchor"), F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.col("_span.granularity").alias("granularity"), text.alias("candidate_text"))
    return rows.withColumn("event", F.when(F.col("_point").isNotNull(), event))


# --- tiers --------------------------------------------------------------------------------------------------------------


def ranked_candidates(titles: DataFrame, tagged: str | None = None) -> DataFrame:
    """A row (id, text, start, score, rank) for each distinct candidate of titles (id, title, lang)."""
    from pyspark.sql import Window

    rows = titles.select("id", "title", F.explode(distinct_candidates(candidates(F.col("title"), F.col("lang"), F.col(tagged) if tagged else None))).alias("c"))
    rows = rows.select("id", "c.text", "c.start", "c.ord", score(F.col("c.text"), F.col("c.start"), F.col("title")).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "start", "ord")
    return rows.withColumn("rank", F.row_number().over(order)).drop("ord")


def extract(titles: DataFrame, corrected: bool = False, tagged: str | None = None) -> DataFrame:
    """Adds event_timestamp, event_time_start, event_time_end, time_granularity, event_text and parse_mode to titles.

    titles: id, title, standard_timestamp and, if already known, lang; every row comes back, repeated ones too. Tier 1
    takes the best ranked candidate that parses, tier 2 reads the whole title by the grammar, else the day of
    publication stands as fallback; without publication time or title the event is null, or the day, and mode fallback.
    """
    base = F.col("standard_timestamp").cast("timestamp_ntz")
    rows = titles if "lang" in titles.columns else titles.withColumn("lang", language(F.col("title")))
    keep = rows.columns
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_kept"), base.alias("base"), prefer_hint(F.coalesce("title", F.lit(""))).alias("hint"), "lang", F.coalesce("title", F.lit("")).alias("_title"))
    usable = F.col("base").isNotNull() & (F.col("_title") != "") & F.coalesce(~F.col("lang").isin("unknown", "empty"), F.lit(False))
    tags = F.col(f"_kept.{tagged}") if tagged else None
    # a title without a figure, a month or a word of time holds no candidate, and no search for one
    may = F.lit(True) if tagged else F.col("_title").rlike(P.MAY_HOLD)
    rows = rows.withColumn("_found", F.when(usable & may, distinct_candidates(candidates(F.col("_title"), F.col("lang"), tags))))
    title = F.col("_title")
    one = lambda c, rank, last: F.struct(F.lit(last).alias("last"), rank.alias("rank"), c["start"].alias("start"), c["ord"].alias("ord"), c["text"].alias("text"))
    scored = F.transform("_found", lambda c: one(c, -score(c["text"], c["start"], title), 0))
    unscored = F.transform("_found", lambda c: one(c, F.lit(0), 0))
    whole = F.struct(F.lit(1).alias("last"), F.lit(0).alias("rank"), F.lit(0).alias("start"), F.lit(0).alias("ord"), ascii_width(title).alias("text"))
    kind = "array<struct<last:int,rank:int,start:int,ord:int,text:string>>"
    ranked = F.when(F.size("_found") > 1, F.array_sort(scored.cast(kind))).otherwise(F.coalesce(unscored.cast(kind), F.array().cast(kind)))
    rows = rows.withColumn("_all", F.when(usable, F.concat(ranked, F.array(whole).cast(kind)))).drop("_found", "_title")
    steps = parse_steps(corrected)
    rows = parsed(rows.withColumns({"_first": F.get("_all", 0), "text": F.get("_all", 0)["text"]}), steps=steps).withColumnRenamed("event", "_event")
    rest = F.when(F.col("_event").isNull() & (F.size("_all") > 1), F.slice("_all", 2, F.size("_all")))
    rows = rows.withColumn("_c", F.explode_outer(rest)).drop("_all").withColumn("text", F.col("_c.text"))
    rows = parsed(rows, steps=steps)
    event, chosen = F.coalesce("_event", "event"), F.when(F.col("_event").isNotNull(), F.col("_first")).otherwise(F.col("_c"))
    rank = F.when(event.isNotNull(), F.struct(chosen["last"], chosen["rank"], chosen["start"], chosen["ord"]))
    best = F.min_by(F.struct(event.alias("event"), chosen["last"].alias("last")), rank)
    out = rows.groupBy("_row").agg(F.first("_kept").alias("_kept"), best.alias("_best")).select("_kept.*", "_best")
    floor = F.date_trunc("day", base).cast("timestamp_ntz")
    found = F.col("_best.event")
    time = lambda c: F.coalesce(found[c].cast("timestamp_ntz"), floor)
    return out.withColumns(
        {
            "event_timestamp": time("anchor"),
            "event_time_start": time("start"),
            "event_time_end": time("end"),
            "time_granularity": F.coalesce(found["granularity"], F.when(base.isNotNull(), "day")),
            "event_text": F.coalesce(found["candidate_text"], F.when(base.isNotNull(), "fallback")),
            "parse_mode": F.when(found.isNull(), "fallback").when(F.col("_best.last") == 1, "tier2").otherwise("tier1"),
        }
    ).drop("_best")


def tier_counts(events: DataFrame) -> DataFrame:
    """How many rows each mode settled."""
    return events.groupBy("parse_mode").agg(F.count("*").alias("n"))

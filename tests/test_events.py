from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from dateloom.functions.lang import language
from dateloom.functions.text import ascii_width, json_array_text, matches, prefer_hint, reply_text
from dateloom.operators.events import extract, parsed

BASE = "2026-03-20 10:00:00"
D = date
VECTORS = [
    ("18/03/2025", "fr", BASE, "x", D(2025, 3, 18), D(2025, 3, 18), D(2025, 3, 18), "day"),
    ("03/04/2025", "en", BASE, "x", D(2025, 3, 4), D(2025, 3, 4), D(2025, 3, 4), "day"),
    ("03/04/2025", "es", BASE, "x", D(2025, 4, 3), D(2025, 4, 3), D(2025, 4, 3), "day"),
    ("March 18, 2025", "en", BASE, "x", D(2025, 3, 18), D(2025, 3, 18), D(2025, 3, 18), "day"),
    ("March 18 2025", "en", BASE, "x", D(2026, 3, 18), D(2026, 3, 18), D(2026, 3, 18), "day"),
    ("18 March 2025", "en", BASE, "x", D(2025, 3, 18), D(2025, 3, 1), D(2025, 3, 31), "month"),
    ("2025年3月18日", "zh-cn", BASE, "x", D(2025, 3, 18), D(2025, 3, 18), D(2025, 3, 18), "day"),
    ("2025年3月", "zh-cn", BASE, "x", D(2025, 3, 31), D(2025, 3, 1), D(2025, 3, 31), "month"),
    ("3月18日", "zh-cn", BASE, "x", D(2026, 3, 18), D(2026, 3, 18), D(2026, 3, 18), "day"),
    ("12月25日", "zh-cn", BASE, "将于", D(2025, 12, 25), D(2025, 12, 25), D(2025, 12, 25), "day"),
    ("1-11月", "zh-cn", BASE, "x", D(2026, 3, 20), D(2026, 1, 1), D(2026, 11, 30), "month_span"),
    ("1到11月", "zh-cn", BASE, "x", D(2026, 11, 30), D(2026, 1, 1), D(2026, 11, 30), "month_span"),
    ("前三季度", "zh-cn", "2025-12-01 00:00:00", "x", D(2025, 9, 30), D(2025, 1, 1), D(2025, 9, 30), "quarter_span"),
    ("上半年", "zh-cn", "2025-12-01 00:00:00", "x", D(2025, 6, 30), D(2025, 1, 1), D(2025, 6, 30), "half"),
    ("Q1 FY2025", "en", BASE, "x", D(2025, 3, 31), D(2025, 1, 1), D(2025, 3, 31), "quarter"),
    ("in 2019", "en", BASE, "x", D(2019, 12, 31), D(2019, 1, 1), D(2019, 12, 31), "year"),
    ("by 2030", "en", BASE, "x", D(2030, 12, 31), D(2030, 1, 1), D(2030, 12, 31), "year"),
    ("since 2020", "en", BASE, "x", D(2020, 1, 1), D(2020, 1, 1), D(2020, 12, 31), "year"),
    ("2025-3-18", "en", BASE, "x", D(2025, 3, 18), D(2025, 3, 18), D(2025, 3, 18), "day"),
    ("2025-03-18", "en", BASE, "x", D(2025, 3, 18), D(2025, 1, 1), D(2103, 12, 31), "year_span"),
    *[(t, "en", BASE, "x", None, None, None, None) for t in ("may", "25%", "第15届", "1500", "", "２５％")],
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, *v[:4]) for i, v in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, "i int, text string, lang string, b string, title string")
    df = df.withColumn("base", F.col("b").cast("timestamp_ntz")).withColumn("hint", prefer_hint(F.col("title")))
    return {r.i: r.event for r in parsed(df).select("i", "event").collect()}


@pytest.mark.parametrize("i", range(len(VECTORS)), ids=[f"{v[0]}-{v[1]}" for v in VECTORS])
def test_candidate(found, i):
    e = found[i]
    got = (e.anchor, e.start, e.end, e.granularity) if e else (None,) * 4
    assert got == VECTORS[i][4:]


def test_corrected_takes_full_dates_first(spark):
    df = spark.createDataFrame([("2025-03-18",), ("18 March 2025",)], "text string").withColumns({"base": F.lit(BASE).cast("timestamp_ntz"), "hint": F.lit("current_period"), "lang": F.lit("en")})
    assert {r.event.granularity for r in parsed(df, corrected=True).collect()} == {"day"}


def test_extract_tiers_and_nulls(spark):
    rows = [("a", "Summit on March 18, 2026", BASE), ("b", "No date here", BASE), ("c", None, BASE), ("d", "", BASE), ("e", "March 18, 2026", None), ("f", "!!! ???", BASE), ("a", "Summit on March 18, 2026", BASE)]
    df = spark.createDataFrame(rows, "id string, title string, t string").select("id", "title", F.col("t").cast("timestamp_ntz").alias("standard_timestamp"))
    rows = extract(df).collect()
    out = {r.id: r for r in rows}
    assert len(rows) == 7 and len(out) == 6 and len({tuple(r) for r in rows if r.id == "a"}) == 1
    assert out["a"].parse_mode == "tier1" and out["a"].event_timestamp == datetime(2026, 3, 18)
    assert all(out[k].parse_mode == "fallback" and out[k].event_timestamp == datetime(2026, 3, 20) for k in "bcdf")
    assert out["e"].event_timestamp is None and out["e"].time_granularity is None and out["e"].parse_mode == "fallback"
    assert extract(df.limit(0)).count() == 0


def test_whole_titles(spark):
    """Titles without a candidate are read whole: numbers in words, weeks, months, weekdays; of others the day of publication stands."""
    told = {
        "The meeting in three weeks": D(2026, 4, 10), "It fell two days ago": D(2026, 3, 18), "An accident a month ago": D(2026, 2, 20), "Ten years earlier, the mayor fell": D(2016, 3, 20),
        "Strike on Monday": D(2026, 3, 16), "Talks this Sunday": D(2026, 3, 22), "Riots spread, police in town": None, "in 40 weeks it ends": D(2026, 12, 25),
    }
    df = spark.createDataFrame(list(enumerate(told)), "id int, title string").withColumns({"standard_timestamp": F.lit(BASE).cast("timestamp_ntz"), "lang": F.lit("en")})
    out = {r.title: r for r in extract(df).collect()}
    for title, want in told.items():
        got = (out[title].parse_mode, out[title].event_timestamp.date())
        assert got == (("tier2", want) if want and want.year > 2020 else ("fallback", D(2026, 3, 20))), title


def test_weekdays_next_and_last(spark):
    df = spark.createDataFrame([(t,) for t in ("last friday", "next friday", "last monday", "next monday", "next week", "last night")], "text string")
    df = df.withColumns({"base": F.lit(BASE).cast("timestamp_ntz"), "hint": F.lit("current_period"), "lang": F.lit("en")})
    got = {r.text: r.event and r.event.anchor for r in parsed(df).collect()}
    assert got == {"last friday": D(2026, 3, 13), "next friday": D(2026, 3, 27), "last monday": D(2026, 3, 16), "next monday": D(2026, 3, 23), "next week": D(2026, 3, 27), "last night": None}


def test_the_best_candidate_that_parses(spark):
    """Where the best ranked one does not parse the next does, before the whole title."""
    df = spark.createDataFrame([(1, "Prices of last summer, seen in 2024"), (2, "last night, next day"), (3, "31/31/2025 was wrong, 5 May 2025 is right")], "id int, title string")
    out = {r.id: r for r in extract(df.withColumns({"standard_timestamp": F.lit(BASE).cast("timestamp_ntz"), "lang": F.lit("en")})).collect()}
    assert (out[1].event_text, out[1].parse_mode) == ("in 2024", "tier1") and out[2].parse_mode == "fallback"
    assert (out[3].event_text, out[3].event_timestamp) == ("5 May 2025", datetime(2025, 5, 5))


def test_gold_keeps_repeated_rows(spark):
    from dateloom.operators.gold import with_gold

    rows = [(1, "Launch of May 5, 2025"), (1, "Launch of May 5, 2025"), (2, None), (3, "Cost rose to $2025-03-04 in 2024")]
    df = spark.createDataFrame(rows, "id int, title string").withColumns({"standard_timestamp": F.lit(BASE).cast("timestamp_ntz"), "lang": F.lit("en"), "gold": F.lit(1)})
    out = sorted(((r.id, r.gold.pattern if r.gold else None) for r in with_gold(df).collect()), key=str)
    assert out == [(1, "en_mdy"), (1, "en_mdy"), (2, None), (3, "year_context")]


def test_span_holds_anchor_and_width_does_not_matter(spark):
    titles = ["会议３月１８日举行", "会议3月18日举行", "Ｑ1 2025 results", "Plans in 2024 and 2025"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string").withColumn("standard_timestamp", F.lit(BASE).cast("timestamp_ntz"))
    out = {r.id: r for r in extract(df).collect()}
    assert out[0].event_timestamp == out[1].event_timestamp
    for r in out.values():
        assert r.event_time_start <= r.event_timestamp <= r.event_time_end


def test_text_functions(spark):
    df = spark.createDataFrame([("a 2025 b😀 2026",)], "t string")
    found = df.select(matches(F.col("t"), r"\d{4}").alias("m")).first().m
    assert [(x.text, x.start) for x in found] == [("2025", 2), ("2026", 10)]
    row = df.select(ascii_width(F.lit("　１２：３０ ")).alias("w"), json_array_text(F.lit('x ```json\n[{"a":1}]\n``` y')).alias("j"), json_array_text(F.lit("none")).alias("n"), reply_text(F.lit('{"response":" hi ","done":true}')).alias("r"), reply_text(F.lit('{"response":"x","done":false}')).alias("q")).first()
    assert (row.w, row.j, row.n, row.r, row.q) == ("12:30", '[{"a":1}]', "none", "hi", None)


def test_language(spark):
    texts = {"The talks of the leaders": "en", "伊朗 新闻": "zh-cn", "El presidente de la república": "es", "Le président de la France est dans les": "fr", "Новости дня": "ru", "Україна і світ": "uk", "뉴스 속보": "ko", "": "empty", "  ": "empty", "123 !!": "unknown"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", language(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == texts


def test_candidates_are_searched_once(spark):
    """However many candidates a title has: a lambda runs again for each of them what it names from outside."""
    from dateloom.functions import patterns as P
    from dateloom.operators.events import candidates, distinct_candidates

    df = spark.createDataFrame([("On 5 May 2025, 5 May 2025 and 2024, 2024",), (None,)], "t string").select(distinct_candidates(candidates(F.col("t"), F.lit("en"))).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == len(P.CANDIDATES)
    rows = [[(c.text, c.start) for c in r.c] for r in df.collect()]
    assert sorted(rows, key=len) == [[], [("2025", 9), ("2025", 21), ("2024", 30), ("2024", 36), ("5 May 2025", 3), ("5 May 2025", 15), ("May 2025", 5), ("May 2025", 17)]]

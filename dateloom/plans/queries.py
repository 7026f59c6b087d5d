"""The library's operators as queries over the driver's tables, and what SQL says of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dateloom import sinks
from dateloom.functions import dates as D
from dateloom.functions import text as T
from dateloom.functions.lang import language
from dateloom.operators import annotate, clusters, evaluate, events, gold, sampling, timeline
from dateloom.plans.titles import TEMPLATES, WHOLE, event_query, event_sql, mixed_sql, rendered
from dateloom.schema import backfill_events
from dateloom.sources import feeds, files
from dateloom.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def stamp(c, pattern: str = "yyyy-MM-dd HH:mm:ss"):
    return F.date_format(c, pattern)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _orders(spark, sf_dir):
    return ntz(table(spark, sf_dir, "orders"), "o_orderdate")


# --- publication times, sources, filters -------------------------------------------------------------------------------


@query("""
    SELECT event_id AS id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS standard_timestamp FROM events WHERE event_id % 4 < 2
    UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 2
""")
def standardize_raw_time(spark, sf_dir):
    """Both compact forms and bad rows; rows without raw time are not read at all."""
    e = ntz(table(spark, sf_dir, "events"), "ts")
    turn = F.col("event_id") % 4
    raw = F.when(turn == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(turn == 1, F.date_format("ts", "yyyyMMddHHmmss")).when(turn == 2, F.date_format("ts", "yyyyMMdd"))
    rows = e.select(F.col("event_id").alias("id"), raw.alias("raw_time"), F.lit(None).cast("timestamp_ntz").alias("standard_timestamp"))
    return files.unstandardised(rows).select("id", stamp(D.standard_time(F.col("raw_time"))).alias("standard_timestamp"))


@query("""
    SELECT CAST(ts + INTERVAL 8 HOUR AS DATE)::VARCHAR AS day, event_type AS source, count(*) AS n
    FROM events GROUP BY ALL
""")
def standardized_per_day(spark, sf_dir):
    e = ntz(table(spark, sf_dir, "events"), "ts")
    day = F.date_format(D.standard_time(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")), "yyyy-MM-dd")
    return e.groupBy(day.alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


@query("""
    SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mail, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS zoned, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events
""")
def lenient_times(spark, sf_dir):
    """RFC 2822 and ISO 8601 times, as the extension reads them."""
    e = ntz(table(spark, sf_dir, "events"), "ts")
    mail = F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(F.col("event_id").alias("id"), stamp(D.mail_time(F.concat(mail, F.lit(" GMT")))).alias("mail"), stamp(D.mail_time(F.concat(mail, F.lit(" +0200")))).alias("zoned"), stamp(D.iso_time(iso)).alias("iso"))


@query("""
    SELECT event_id AS id, CASE event_id % 5
        WHEN 0 THEN strftime(ts - to_days(CAST(event_id % 9 AS INT)), '%Y-%m-%dT%H:%M:%S+08:00')
        WHEN 1 THEN strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S+08:00')
        WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00')
        WHEN 3 THEN strftime(date_trunc('minute', ts) + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') END AS parsed_time FROM events
""")
def heterogeneous_times(spark, sf_dir):
    """Days ago, published dates, Chinese and English forms with offset, and text that is no time."""
    e = ntz(table(spark, sf_dir, "events"), "ts")
    turn = F.col("event_id") % 5
    raw = (
        F.when(turn == 0, F.concat((F.col("event_id") % 9).cast("string"), F.lit(" days ago")))
        .when(turn == 1, F.concat(F.lit("Published "), F.date_format("ts", "MM/dd/yyyy"), F.lit(" | last updated 17 hours ago")))
        .when(turn == 2, F.date_format("ts", "yyyy年MM月dd日 HH:mm:ss"))
        .when(turn == 3, F.concat(F.date_format("ts", "MMM d, yyyy, HH:mm"), F.lit(" GMT+1")))
        .otherwise("soon")
    )
    return e.select(F.col("event_id").alias("id"), D.iso_text(D.heterogeneous_time(raw, F.col("ts"))).alias("parsed_time"))


@query("""
    SELECT page_id, regexp_matches(lower(url), 'example.com|example.org') AS wanted,
           CASE WHEN contains(lower(url), 'example.com') THEN 'example.com' WHEN contains(lower(url), 'example.org') THEN 'example.org' ELSE 'Unknown' END AS source
    FROM pages
""")
def domain_filter(spark, sf_dir):
    domains = ("example.com", "example.org")
    return table(spark, sf_dir, "pages").select("page_id", feeds.of_domains(F.col("url"), domains).alias("wanted"), feeds.source_label(F.col("url"), domains).alias("source"))


@query("SELECT page_id, 'gdelt_' || substr(sha256(url), 1, 32) AS id FROM pages WHERE strlen(url) > 0")
def source_ids(spark, sf_dir):
    return feeds.with_required(table(spark, sf_dir, "pages"), "url").select("page_id", files.source_id("gdelt", F.col("url")).alias("id"))




@query("""
    SELECT 'http://feed.example/v2/' || strftime(o_orderdate, '%Y%m%d') || '000000.export.CSV.zip' AS url, strftime(o_orderdate, '%Y%m%d') AS day, count(*) AS n
    FROM orders WHERE o_orderkey % 3 <> 0 AND strftime(o_orderdate, '%Y%m%d') BETWEEN '19970101' AND '19970630' GROUP BY ALL
""")
def file_list_prune(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "mentions").otherwise("export")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.concat(F.lit("http://feed.example/v2/"), day, F.lit("000000."), kind, F.lit(".CSV.zip")))
    found = files.listed_exports(_orders(spark, sf_dir).select(line.alias("value")), "19970101", "19970630")
    return found.groupBy("url", "day").agg(F.count("*").alias("n"))


@query("""
    SELECT event_id AS id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN true ELSE date_trunc('second', ts) >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY END AS kept FROM events
""")
def lookback_filter(spark, sf_dir):
    e = ntz(table(spark, sf_dir, "events"), "ts")
    raw = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, "no date").otherwise(F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return e.select(F.col("event_id").alias("id"), feeds.within_lookback(raw, F.lit("2024-01-20").cast("timestamp_ntz")).alias("kept"))


@query("""
    WITH d AS (SELECT doc_id, source, 'http://x/' || (doc_id // 2) AS url FROM documents),
         k AS (SELECT DISTINCT CASE WHEN doc_id % 10 = 0 THEN url ELSE url || '/old' END AS url FROM d),
         f AS (SELECT * FROM d WHERE url NOT IN (SELECT url FROM k) QUALIFY row_number() OVER (PARTITION BY url ORDER BY source, doc_id) = 1)
    SELECT doc_id AS position, source, url FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20
""")
def per_source_cap(spark, sf_dir):
    """What a run keeps of feeds: unknown URLs, each once, twenty of a source."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("position"), F.concat(F.lit("http://x/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.lit("t").alias("title"), F.lit("").alias("raw_time"))
    known = d.select(F.when(F.col("position") % 10 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/old"))).alias("url"))
    kept = feeds.fresh_items(d, known, F.lit("2024-01-20").cast("timestamp_ntz"))
    return kept.select("position", "source", "url")


@query("""
    WITH b AS (SELECT event_type AS source, min(date_trunc('second', ts)) AS s, max(date_trunc('second', ts)) AS e FROM events GROUP BY 1),
         w AS (SELECT source, e, unnest(generate_series(s, e - INTERVAL 1 SECOND, INTERVAL '7 days 1 second')) AS a FROM b WHERE s < e)
    SELECT source, strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(least(a + INTERVAL 7 DAY, e), '%Y-%m-%d %H:%M:%S') AS window_end FROM w
""")
def fetch_windows(spark, sf_dir):
    e = ntz(table(spark, sf_dir, "events"), "ts").withColumn("t", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    bounds = e.groupBy(F.col("event_type").alias("source")).agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return feeds.fetch_windows(bounds).select("source", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"))


@query("""
    WITH s AS (SELECT DISTINCT event_type AS source FROM events UNION SELECT 'none'),
         m AS (SELECT event_type AS source, max(date_trunc('second', ts)) AS t FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
    SELECT s.source, strftime(CASE WHEN length(s.source) % 2 = 0 AND s.source <> 'none' THEN TIMESTAMP '2024-02-01 00:00:00'
           ELSE coalesce(m.t + INTERVAL 1 SECOND, TIMESTAMP '2025-06-01 00:00:00') END, '%Y-%m-%d %H:%M:%S') AS next_start
    FROM s LEFT JOIN m USING (source)
""")
def checkpoint_fallback(spark, sf_dir):
    e = ntz(table(spark, sf_dir, "events"), "ts")
    prefix = F.when(F.col("event_id") % 3 == 0, "rss_").otherwise("gdelt_")
    news = e.select(F.col("event_type").alias("source"), F.concat(prefix, F.col("event_id").cast("string")).alias("id"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("raw_time"))
    sources = news.select("source").union(spark.createDataFrame([("none",)], "source string"))
    saved = news.select("source").distinct().where(F.length("source") % 2 == 0).withColumn("next_start_time", F.lit("20240201T000000Z"))
    return feeds.next_starts(sources, saved, news).select("source", stamp("next_start").alias("next_start"))


# --- sinks ---------------------------------------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages)
    SELECT min(page_id) AS page_id, url FROM r WHERE url NOT IN (SELECT CASE WHEN page_id % 5 = 0 THEN url ELSE url || '#old' END FROM pages) GROUP BY url
""")
def append_ignore(spark, sf_dir):
    """All pages twice, under other keys, against a target that holds the URLs of every fifth as they are."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = p.unionByName(p.withColumn("page_id", F.col("page_id") + 1_000_000))
    target = p.withColumn("url", F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#old"))))
    return sinks.append_new(target, rows, "url", ["page_id"])


@query("SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def url_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return sinks.append_new(p.limit(0), p, "url", ["page_id"])


def _orders_and_changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All orders as a target, and a change for each: every third to its own key, the others to keys that are new."""
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changes = o.select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000_000).alias("id"), F.lit("new").alias("status"), F.round(F.col("price") * 2, 2).alias("price"))
    return o, changes


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders
    UNION ALL SELECT o_orderkey + 1000000000, 'new', round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 3 <> 0
""")
def upsert_full(spark, sf_dir):
    return sinks.upserted(*_orders_and_changes(spark, sf_dir))


@query("""
    SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders
    UNION ALL SELECT o_orderkey + 1000000000, 'new', round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 3 <> 0
""")
def upsert_partial(spark, sf_dir):
    return sinks.partially_upserted(*_orders_and_changes(spark, sf_dir), ["price"])


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders")
def keyed_update(spark, sf_dir):
    return sinks.updated(*_orders_and_changes(spark, sf_dir), ["price"])


@query("""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS event_time_start, strftime(o_orderdate, '%Y-%m-%d') AS event_time_end,
           CASE WHEN o_orderdate IS NULL THEN 'missing_event' WHEN o_orderkey % 3 = 0 THEN 'fallback_like' ELSE 'parsed_like' END AS parse_mode FROM orders
""")
def optional_schema_backfill(spark, sf_dir):
    o = _orders(spark, sf_dir)
    standard = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 1 day"))
    rows = backfill_events(o.select(F.col("o_orderkey").alias("id"), standard.alias("standard_timestamp"), F.col("o_orderdate").alias("event_timestamp")))
    return rows.select("id", stamp("event_time_start", "yyyy-MM-dd").alias("event_time_start"), stamp("event_time_end", "yyyy-MM-dd").alias("event_time_end"), "parse_mode")


# --- text ------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || ' (x)' AS text FROM orders")
def fullwidth_normalize(spark, sf_dir):
    wide = F.translate(F.date_format("o_orderdate", "yyyy-MM-dd"), "0123456789-", "０１２３４５６７８９－")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), T.ascii_width(F.concat(F.lit("　"), wide, F.lit("　（x） "))).alias("text"))


_HINTS = ("Summit to be held in May", "Williams wins", "Chicago fire", "会议将于周五举行", "此前报道", "Fire in Paris", "Next stop, last call")


@query("SELECT o_orderkey AS id, (['future', 'future', 'past', 'future', 'past', 'current_period', 'future'])[CAST(o_orderkey % 7 + 1 AS INT)] AS hint FROM orders")
def prefer_hint(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, _HINTS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), T.prefer_hint(title).alias("hint"))


@query(r"""
    WITH d AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n\t]+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents),
         e AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Empty.' WHEN c = '' OR ends_with(c, '.') THEN c ELSE c || '.' END AS c FROM d)
    SELECT doc_id, md5(c || CASE WHEN length(c) < 20 THEN ' This news was published on ' ELSE ' Published on ' END || '2024-01-20.') AS input_md5 FROM e
""")
def heidel_input(spark, sf_dir):
    """Annotator input of whole texts, as a digest."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.md5(T.annotator_input(F.col("text"), F.lit("2024-01-20").cast("timestamp_ntz")).cast("binary")).alias("input_md5"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang")
def language_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2)).orderBy(F.desc("n"), "lang")


@query()
def language_detect_accuracy(spark, sf_dir):
    """How often each label is detected as each language. The detector is a substitute, so SQL cannot tell."""
    return spread(table(spark, sf_dir, "documents")).groupBy("lang", language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("""
    SELECT c.conv_id, '[{"id":"' || c.conv_id || '","event_type":"x"}]' AS json_text, 1 AS n_steps FROM (SELECT DISTINCT conv_id FROM conversations) c
""")
def json_array_extract(spark, sf_dir):
    body = F.concat(F.lit('[{"id":"'), F.col("conv_id").cast("string"), F.lit('","event_type":"x"}]'))
    reply = F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("reply", reply)
    return c.select("conv_id", T.json_array_text(F.col("reply")).alias("json_text"), F.size(F.from_json(T.json_array_text(F.col("reply")), F.lit(timeline.REPLY))).alias("n_steps"))


# --- ranges and years ----------------------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS id, g AS granularity, strftime(CASE g WHEN 'day' THEN d WHEN 'month' THEN date_trunc('month', d) ELSE date_trunc('year', d) END, '%Y-%m-%d') AS s,
           strftime(CASE g WHEN 'day' THEN d WHEN 'month' THEN last_day(d) ELSE make_date(year(d), 12, 31) END, '%Y-%m-%d') AS e
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT unnest(['day', 'month', 'year']) AS g)
""")
def range_by_granularity(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("granularity", F.explode(F.array(F.lit("day"), F.lit("month"), F.lit("year"))))
    r = D.range_by(F.col("o_orderdate"), F.col("granularity"))
    return rows.select(F.col("o_orderkey").alias("id"), "granularity", r["start"].cast("string").alias("s"), r["end"].cast("string").alias("e"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(least(d, d + to_days(k)), '%Y-%m-%d') END AS s, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(greatest(d, d + to_days(k)), '%Y-%m-%d') END AS e
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 7 - 3 AS INT) AS k FROM orders)
""")
def normalize_range(spark, sf_dir):
    o = _orders(spark, sf_dir)
    d = D.day(F.col("o_orderdate"))
    other = F.when(F.col("o_orderkey") % 10 != 0, F.date_add(d, (F.col("o_orderkey") % 7 - 3).cast("int")))
    r = D.span(d, other)
    return o.select(F.col("o_orderkey").alias("id"), r["start"].cast("string").alias("s"), r["end"].cast("string").alias("e"))


@query("""
    SELECT o_orderkey AS id, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS qs, strftime(last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH), '%Y-%m-%d') AS qe,
           CASE WHEN month(d) < 7 THEN year(d) || '-01-01' ELSE year(d) || '-07-01' END AS hs, CASE WHEN month(d) < 7 THEN year(d) || '-06-30' ELSE year(d) || '-12-31' END AS he
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def quarter_half_range(spark, sf_dir):
    o = _orders(spark, sf_dir)
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    a, b = D.quarter_span(y, D.quarter_number(F.substring(F.lit("一二三四"), q, F.lit(1)))), D.half_span(y, F.when(q < 3, 1).otherwise(2))
    return o.select(F.col("o_orderkey").alias("id"), *[s[k].cast("string").alias(n) for s, k, n in ((a, "start", "qs"), (a, "end", "qe"), (b, "start", "hs"), (b, "end", "he"))])


@query("""
    WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 101 - 40 AS INT) AS b,
                      (['future', 'past', 'current_period'])[CAST(o_orderkey % 3 + 1 AS INT)] AS hint, (['by then', 'since then', 'x', '截至'])[CAST(o_orderkey % 4 + 1 AS INT)] AS words FROM orders)
    SELECT id, strftime(CASE WHEN words IN ('by then', '截至') THEN e WHEN words = 'since then' THEN s WHEN b BETWEEN s AND e THEN b WHEN hint = 'future' AND b < s THEN s WHEN hint = 'past' AND b > e THEN e
           WHEN abs(b - s) <= abs(b - e) THEN s ELSE e END, '%Y-%m-%d') AS anchor FROM r
""")
def choose_anchor(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey"), D.day(F.col("o_orderdate"))
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    rows = o.select(k.alias("id"), D.span(d, F.date_add(d, 30)).alias("s"), F.date_add(d, (k % 101 - 40).cast("int")).cast("timestamp_ntz").alias("b"), pick(("future", "past", "current_period"), 3).alias("hint"), pick(("by then", "since then", "x", "截至"), 4).alias("words"))
    return rows.select("id", D.anchor_in(F.col("s"), F.col("b"), F.col("hint"), F.col("words")).cast("string").alias("anchor"))


@query("""
    WITH r AS (SELECT o_orderkey AS id, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 801 - 400 AS INT) AS b,
                      (['future', 'past', 'current_period'])[CAST(o_orderkey % 3 + 1 AS INT)] AS hint FROM orders),
         y AS (SELECT *, year(b) AS y0, CASE WHEN m = 2 AND d = 29 AND day(last_day(make_date(year(b), 2, 1))) <> 29 THEN NULL ELSE make_date(year(b), m, d) END AS here FROM r),
         t AS (SELECT id, b, unnest([0, -1, 1]) AS k, y0, m, d FROM y),
         c AS (SELECT id, k, y0 + k AS yy, abs(CAST(make_date(y0 + k, m, d) AS DATE) - b) AS far FROM t WHERE NOT (m = 2 AND d = 29 AND day(last_day(make_date(y0 + k, 2, 1))) <> 29)),
         n AS (SELECT id, yy FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, CASE k WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) = 1)
    SELECT y.id, CAST(CASE WHEN here IS NULL THEN NULL
             WHEN hint = 'future' AND here < b - 1 THEN CASE WHEN m = 2 AND d = 29 THEN y0 ELSE y0 + 1 END
             WHEN hint = 'past' AND here > b + 1 THEN CASE WHEN m = 2 AND d = 29 THEN y0 ELSE y0 - 1 END ELSE n.yy END AS BIGINT) AS year
    FROM y LEFT JOIN n USING (id)
""")
def infer_year_month_day(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    rows = o.select(k.alias("id"), F.month(d).alias("m"), F.dayofmonth(d).alias("dom"), F.date_add(D.day(d), (k % 801 - 400).cast("int")).cast("timestamp_ntz").alias("b"), F.element_at(F.array(F.lit("future"), F.lit("past"), F.lit("current_period")), (k % 3 + 1).cast("int")).alias("hint"))
    return rows.select("id", D.year_near(F.col("m"), F.col("dom"), F.col("b"), F.col("hint")).cast("long").alias("year"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_linenumber * 3 AS INT) AS e FROM lineitem)
    SELECT l_linenumber AS line, count(*) AS n, count(*) FILTER (s <= DATE '1997-06-30' AND DATE '1997-01-01' <= e) AS overlapping FROM l GROUP BY 1
""")
def interval_overlap(spark, sf_dir):
    rows = ntz(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_shipdate"), "l_shipdate")
    own = D.span(D.day(F.col("l_shipdate")), F.date_add(D.day(F.col("l_shipdate")), F.col("l_linenumber") * 3))
    half = D.span(F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date"))
    return rows.groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.count_if(D.overlap(own, half)).alias("overlapping"))


@query("""
    WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
    SELECT id, CASE k WHEN 0 THEN strftime(date_trunc('quarter', d), '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('week', d), '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('month', d), '%Y-%m-%d')
           WHEN 3 THEN strftime(date_trunc('year', d), '%Y-%m-%d') WHEN 4 THEN strftime(d, '%Y-%m-%d') ELSE '2000-01-01' END AS at FROM d
""")
def timex_values(spark, sf_dir):
    o = _orders(spark, sf_dir)
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    value = F.when(k == 0, F.concat(F.year(d), F.lit("-Q"), F.quarter(d))).when(k == 1, week).when(k == 2, F.date_format(d, "yyyy-MM")).when(k == 3, F.year(d).cast("string")).when(k == 4, F.date_format(d, "yyyy-MM-dd")).otherwise("PRESENT_REF")
    listed = F.array(F.struct(F.lit("DURATION").alias("type"), F.lit("P1D").alias("value")), F.struct(F.lit("DATE").alias("type"), value.alias("value")))
    return o.select(F.col("o_orderkey").alias("id"), stamp(D.timex_date(D.timex_pick(listed), F.lit("2000-01-01").cast("timestamp_ntz")), "yyyy-MM-dd").alias("at"))


# --- event time ------------------------------------------------------------------------------------------------------------------

for _name in TEMPLATES:
    QUERIES[f"event_time_{_name}"] = event_query(_name)
    SQL[f"event_time_{_name}"] = event_sql(_name)
QUERIES["event_time_pipeline"] = event_query(None)
SQL["event_time_pipeline"] = mixed_sql()


@query(f"SELECT CASE WHEN o_orderkey % {len(TEMPLATES)} = {list(TEMPLATES).index('fallback')} THEN 'fallback' WHEN o_orderkey % {len(TEMPLATES)} IN ({', '.join(str(list(TEMPLATES).index(n)) for n in WHOLE)}) THEN 'tier2' ELSE 'tier1' END AS parse_mode, count(*) AS n FROM orders GROUP BY 1")
def tier_counts(spark, sf_dir):
    return events.tier_counts(events.extract(rendered(spark, sf_dir)))


#: Titles of four kinds by key: dates in front, in figures, and a year after an outlet's name, without and with an earlier month.
_RANKED = ("concat('Summit to be held on ', date_format(d, 'MMMM d, yyyy'), ' in Paris')", "concat('Ceremony on ', date_format(d, 'dd/MM/yyyy'), ' – Reuters')", "concat('Talks of the leaders in town end – Reuters ', year(d))", "concat('March talks of the leaders in town end – Reuters ', year(d))")


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, strftime(o_orderdate, '%B') AS m, strftime(o_orderdate, '%-d') AS d, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%d/%m/%Y') AS f FROM orders),
         c AS (SELECT id, m || ' ' || d || ', ' || y AS text, 21 AS start, 55 AS points, 1 AS ord FROM o WHERE k = 0
               UNION ALL SELECT id, m || ' ' || d, 21, 55, 2 FROM o WHERE k = 0
               UNION ALL SELECT id, 'on ' || m, 18, 30, 3 FROM o WHERE k = 0
               UNION ALL SELECT id, y, 21 + length(m) + length(d) + 3, 28, 0 FROM o WHERE k = 0
               UNION ALL SELECT id, f, 12, 56, 0 FROM o WHERE k = 1 UNION ALL SELECT id, y, 18, 28, 1 FROM o WHERE k = 1
               UNION ALL SELECT id, y, 43, 28 - 18, 0 FROM o WHERE k = 2 UNION ALL SELECT id, y, 49, 28 - 45, 0 FROM o WHERE k = 3),
         s AS (SELECT id, text, start, ord, points - start // 20 AS score FROM c)
    SELECT id, text, start, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, ord) AS rank FROM s
""")
def candidate_ranking(spark, sf_dir):
    """Every candidate of a title of each order, with its score, among them source tails with and without an earlier date."""
    turn = F.col("o_orderkey") % len(_RANKED)
    titles = _orders(spark, sf_dir).withColumn("d", F.col("o_orderdate"))
    title = F.coalesce(*[F.when(turn == k, F.expr(t)) for k, t in enumerate(_RANKED)])
    return events.ranked_candidates(spread(titles.select(F.col("o_orderkey").alias("id"), title.alias("title"), F.lit("en").alias("lang"))))


#: Texts by key: (Spark SQL over the key k and the date d, DuckDB's word on whether it is noise).
_NOISE = (
    ("''", "true"), ("concat('第', k, '届')", "true"), ("concat(k, '%')", "true"), ("concat(k, ' billion')", "true"), ("cast(k as string)", "k NOT BETWEEN 1900 AND 2100"),
    ("date_format(d, 'yyyy')", "false"), ("date_format(d, 'dd/MM/yyyy')", "false"), ("date_format(d, 'MMMM d')", "false"), ("date_format(d, 'yyyy-M-d')", "false"),
    ("date_format(d, 'd MMMM yyyy')", "false"), ("concat('next ', date_format(d, 'EEEE'))", "false"), ("concat(k, ',000')", "true"),
)


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % {len(_NOISE)} " + " ".join(f"WHEN {i} THEN {told.replace('k ', 'o_orderkey ')}" for i, (_, told) in enumerate(_NOISE)) + " END AS noise FROM orders")
def noise_candidates(spark, sf_dir):
    """Texts of each order, in figures and in words, judged as candidates."""
    turn = F.col("o_orderkey") % len(_NOISE)
    o = spread(_orders(spark, sf_dir)).withColumns({"d": F.col("o_orderdate"), "k": F.col("o_orderkey")})
    text = F.coalesce(*[F.when(turn == i, F.expr(t)) for i, (t, _) in enumerate(_NOISE)])
    return o.select(F.col("o_orderkey").alias("id"), events.is_noise(text).alias("noise"))


@query("""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS event_timestamp, 'success' AS outcome FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d'), 'empty' FROM orders WHERE o_orderkey % 3 = 1
    UNION ALL SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d'), 'skipped' FROM orders WHERE o_orderkey % 3 = 2
""")
def annotator_events(spark, sf_dir):
    o = _orders(spark, sf_dir)
    turn, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    title = F.when(turn == 0, F.concat(F.lit("The launch on "), F.date_format(d, "MMMM d, yyyy"))).when(turn == 1, "The talks of the leaders").otherwise("会议举行")
    rows = o.select(F.col("o_orderkey").alias("id"), title.alias("title"), (d + F.expr("interval 3 days")).alias("standard_timestamp"))
    return annotate.annotated(rows).select("id", stamp("event_timestamp", "yyyy-MM-dd").alias("event_timestamp"), "outcome")


@query("""
    SELECT count(*) FILTER (o_orderkey % 3 = 0) AS english_success, 0 AS english_error, count(*) FILTER (o_orderkey % 3 = 1) AS english_empty, count(*) FILTER (o_orderkey % 3 = 2) AS non_english_skipped,
           count(*) FILTER (o_orderkey % 3 <> 0) AS total_fallback FROM orders
""")
def annotator_counts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    turn, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    title = F.when(turn == 0, F.concat(F.lit("The launch on "), F.date_format(d, "MMMM d, yyyy"))).when(turn == 1, "The talks of the leaders").otherwise("会议举行")
    return annotate.outcomes(annotate.annotated(o.select(F.col("o_orderkey").alias("id"), title.alias("title"), d.alias("standard_timestamp"))))


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 5 <> 4) AS parsed, count(*) FILTER (event_id % 5 = 4) AS failed FROM events")
def parse_counts(spark, sf_dir):
    return evaluate.parse_counts(heterogeneous_times(spark, sf_dir), "parsed_time")


# --- evaluation --------------------------------------------------------------------------------------------------------------------

_MONTH, _YEAR = ("date_trunc('month', d)", "last_day(d)", "month"), ("make_date(year(d), 1, 1)", "make_date(year(d), 12, 31)", "year")
_QUARTER = ("date_trunc('quarter', d)", "last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH)", "month")
_HALF = ("make_date(year(d), CASE WHEN month(d) < 7 THEN 1 ELSE 7 END, 1)", "CASE WHEN month(d) < 7 THEN make_date(year(d), 6, 30) ELSE make_date(year(d), 12, 31) END", "month")
_DAY, _NONE = ("d", "d", "day"), None
#: name of the pattern: (language, title in Spark SQL over d, (start, end, granularity) in DuckDB over d or None for no gold).
_GOLD = {
    "ymd_numeric": ("en", "concat('On ', date_format(d, 'yyyy-MM-dd'), ' it rained')", _DAY),
    "en_mdy": ("en", "concat('Launch of ', date_format(d, 'MMMM d, yyyy'), ' seen')", _DAY),
    "zh_md": ("zh-cn", "concat('会议', month(d), '月', day(d), '日举行')", _DAY),
    "zh_half": ("zh-cn", "concat(year(d), '年', if(month(d) < 7, '上半年', '下半年'), '增长')", _HALF),
    "en_quarter": ("en", "concat('Results Q', quarter(d), ' ', year(d), ' out')", _QUARTER),
    "year_context": ("en", "concat('Plans in ', year(d), ' made')", _YEAR),
    "none": ("en", "'Nothing stated here'", _NONE),
    "amount": ("en", "concat('Cost rose to $', date_format(d, 'yyyy-MM-dd'))", _NONE),
    "zh_ymd": ("zh-cn", "concat('会议', year(d), '年', month(d), '月', day(d), '日举行')", _DAY),
    "en_my": ("en", "concat('Report of ', date_format(d, 'MMMM yyyy'), ' out')", _MONTH),
    "zh_ym": ("zh-cn", "concat(year(d), '年', month(d), '月数据')", _MONTH),
    "relative_day": ("en", "'Rain today in town'", _DAY),
    "relative_month": ("en", "'The fair of this month'", _MONTH),
    "relative_year": ("en", "'The plans of this year'", _YEAR),
    "en_half": ("en", "concat('Review H', if(month(d) < 7, 1, 2), ' ', year(d), ' done')", _HALF),
    "zh_quarter": ("zh-cn", "concat(year(d), '年第', substring('一二三四', quarter(d), 1), '季度增长')", _QUARTER),
    "zh_month_only": ("zh-cn", "concat('会议', month(d), '月举行')", _MONTH),
    "en_month_only": ("en", "concat('Talks in ', date_format(d, 'MMMM'))", _MONTH),
    "search_dates": ("en", "concat('Census ', year(d), ' done')", _YEAR),
    "band": ("en", "'The band The 1975 plays'", _NONE),
    "pair": ("en", "concat('Season ', year(d), '/', year(d) + 1, ' ends')", _NONE),
}
_GOLD_NAMES = list(_GOLD)


def _gold_records(spark, sf_dir) -> DataFrame:
    """Orders as news with a stated date; v1 events are the date plus key % 4 days, v2 events the date plus key % 3."""
    o = spread(_orders(spark, sf_dir)).select("o_orderkey", F.col("o_orderdate").alias("d"))
    turn = F.col("o_orderkey") % len(_GOLD_NAMES)
    title = F.coalesce(*[F.when(turn == k, F.expr(t)) for k, (_, t, _) in enumerate(_GOLD.values())])
    later = lambda n: F.col("d") + F.expr(f"make_dt_interval(cast(o_orderkey % {n} as int))")
    mode = F.when(F.col("o_orderkey") % 5 == 0, "fallback").otherwise("tier1")
    lang = F.when(turn.isin([k for k, (lang, _, _) in enumerate(_GOLD.values()) if lang != "en"]), "zh-cn").otherwise("en")
    rows = o.select(F.col("o_orderkey").alias("id"), title.alias("title"), F.col("d").alias("standard_timestamp"), lang.alias("lang"), mode.alias("parse_mode"), later(4).alias("e1"), later(3).alias("e2"))
    return rows


def _records(rows: DataFrame, event: str) -> DataFrame:
    shared = rows.select("id", "title", "standard_timestamp", "lang", "parse_mode", F.col(event).alias("event_timestamp"))
    return shared.withColumns({"event_time_start": F.col("event_timestamp"), "event_time_end": F.col("event_timestamp"), "time_granularity": F.lit("day")})


def _told(part: int, name: str) -> str:
    """What each kind of title says, by its number k, in DuckDB."""
    quoted = (lambda x: f"'{x}'") if part == 2 else (lambda x: f"CAST({x} AS DATE)")
    return "CASE k " + " ".join(f"WHEN {k} THEN {quoted(told[part])}" for k, (_, _, told) in enumerate(_GOLD.values()) if told) + f" END AS {name}"


_ABROAD = ", ".join(str(k) for k, (lang, _, _) in enumerate(_GOLD.values()) if lang != "en")
_G = f"""
    g AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % {len(_GOLD)} AS k, CASE WHEN o_orderkey % {len(_GOLD)} IN ({_ABROAD}) THEN 'zh-cn' ELSE 'en' END AS lang,
                 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS e1, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) AS e2 FROM orders),
    v AS (SELECT *, k NOT IN ({", ".join(str(k) for k, (_, _, told) in enumerate(_GOLD.values()) if not told)}) AS has, {_told(0, "s")}, {_told(1, "e")}, {_told(2, "gr")} FROM g)
"""


def _flags_sql(event: str) -> str:
    same = f"CASE gr WHEN 'day' THEN {event} = s WHEN 'month' THEN date_trunc('month', {event}) = date_trunc('month', s) ELSE year({event}) = year(s) END"
    flag = lambda test: f"CASE WHEN has AND {test} THEN 1 ELSE 0 END"
    near = f"CASE gr WHEN 'day' THEN abs({event} - s) <= 1 ELSE {same} END"
    return f"SELECT id, lang, has::INT AS ev, {flag(same)} AS ex, {flag(near)} AS re, {flag(f'{event} BETWEEN s AND e')} AS rh, {flag('s <> e')} AS iv FROM v"


_MEASURES = """count(*) AS sample_count, sum(ev)::BIGINT AS evaluable_count, round(sum(ev) / count(*), 4) AS evaluable_coverage, round(sum(ex) / nullif(sum(ev), 0), 4) AS exact_accuracy,
    round(sum(re) / nullif(sum(ev), 0), 4) AS relaxed_accuracy, round(sum(rh) / nullif(sum(ev), 0), 4) AS range_hit_accuracy, round(sum(rh) / nullif(sum(ev), 0), 4) AS anchor_in_gold_range_accuracy,
    sum(iv)::BIGINT AS interval_evaluable_count, round(sum(iv * rh) / nullif(sum(iv), 0), 4) AS interval_range_hit_accuracy"""


@query(f"""
    WITH {_G} SELECT id, CASE WHEN has THEN (['{"', '".join(_GOLD_NAMES)}'])[CAST(k + 1 AS INT)] END AS pattern, CASE WHEN has THEN strftime(s, '%Y-%m-%d') END AS value,
           CASE WHEN has THEN strftime(e, '%Y-%m-%d') END AS range_end, CASE WHEN has THEN gr END AS granularity FROM v
""")
def pseudo_gold(spark, sf_dir):
    rows = gold.with_gold(_gold_records(spark, sf_dir).select("id", "title", "standard_timestamp", "lang"))
    day = lambda c: stamp(F.col("gold." + c), "yyyy-MM-dd")
    return rows.select("id", F.col("gold.pattern").alias("pattern"), day("value").alias("value"), day("range_end").alias("range_end"), F.col("gold.granularity").alias("granularity"))


@query(f"WITH {_G}, f AS ({_flags_sql('e2')}) SELECT lang, {_MEASURES} FROM f GROUP BY GROUPING SETS ((), (lang))")
def eval_metrics_overall_by_lang(spark, sf_dir):
    return evaluate.metrics(evaluate.evaluated(_records(_gold_records(spark, sf_dir), "e2")))


@query(f"WITH {_G} SELECT (['{"', '".join(_GOLD_NAMES)}'])[CAST(k + 1 AS INT)] AS pattern, count(*) AS n FROM v WHERE has GROUP BY 1")
def pattern_distribution(spark, sf_dir):
    flagged = evaluate.evaluated(_records(_gold_records(spark, sf_dir), "e2")).where("is_evaluable = 1")
    return evaluate.distribution(flagged, F.col("gold.pattern")).select(F.explode("distribution").alias("pattern", "n"))


_CONFIDENCE = ", ".join(f"('{name}', '{confidence}')" for name, _, _, confidence in gold.GOLD_PATTERNS) + f", ('{gold.SEARCH}', 'low')"


@query(f"""
    WITH {_G}, f AS ({_flags_sql('e2')}),
         n AS (SELECT (['{"', '".join(_GOLD_NAMES)}'])[CAST(k + 1 AS INT)] AS pattern, count(*) AS n FROM v WHERE has GROUP BY 1),
         c AS (SELECT confidence, sum(n)::BIGINT AS n FROM n JOIN (VALUES {_CONFIDENCE}) c(pattern, confidence) USING (pattern) GROUP BY 1),
         one AS (SELECT {_MEASURES} FROM f)
    SELECT *, 1 AS day_tolerance, 'balanced' AS gold_mode,
           (SELECT '{{' || string_agg('"' || pattern || '":' || n, ',' ORDER BY n DESC, pattern) || '}}' FROM n) AS pseudo_pattern_distribution,
           (SELECT '{{' || string_agg('"' || confidence || '":' || n, ',' ORDER BY n DESC, confidence) || '}}' FROM c) AS pseudo_confidence_distribution FROM one
""")
def evaluation_summary(spark, sf_dir):
    """One row of measures with maps of patterns and confidences, most frequent first."""
    out = evaluate.summary(evaluate.evaluated(_records(_gold_records(spark, sf_dir), "e2")))
    return out.withColumns({c: F.to_json(c) for c in ("pseudo_pattern_distribution", "pseudo_confidence_distribution")})


@query(f"WITH {_G}, f AS ({_flags_sql('e2')}) SELECT id, ev AS is_evaluable, ex AS is_exact, re AS is_relaxed, rh AS is_range_hit, rh AS is_anchor_in_gold_range, iv AS is_interval_gold FROM f")
def evaluation_detail(spark, sf_dir):
    rows = evaluate.detail(evaluate.evaluated(_records(_gold_records(spark, sf_dir), "e2")))
    return rows.select("id", "is_evaluable", "is_exact", "is_relaxed", "is_range_hit", "is_anchor_in_gold_range", "is_interval_gold")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Both versions of all records; a tenth of either has keys that the other lacks."""
    rows = _gold_records(spark, sf_dir)
    key = F.col("id")
    v1 = _records(rows, "e1").withColumn("lang", F.when(key % 4 == 0, F.lit("unknown")).otherwise(F.col("lang")))
    v2 = _records(rows, "e2").withColumn("standard_timestamp", F.when(key % 9 == 0, None).otherwise(F.col("standard_timestamp")))
    return v1.withColumn("id", F.when(key % 10 == 0, key + 1_000_000_000).otherwise(key)), v2.withColumn("id", F.when(key % 10 == 1, key + 2_000_000_000).otherwise(key))


@query(f"""
    WITH {_G} SELECT id, (['{"', '".join(_GOLD_NAMES)}'])[CAST(k + 1 AS INT)] AS kind, lang, strftime(e1, '%Y-%m-%d') AS event_v1, strftime(e2, '%Y-%m-%d') AS event_v2, false AS standard_mismatch
    FROM v WHERE id % 10 > 1
""")
def compare_versions(spark, sf_dir):
    """The join of both versions by id with columns from the better informed side."""
    rows = evaluate.aligned(*_versions(spark, sf_dir))
    kind = F.element_at(F.array(*map(F.lit, _GOLD_NAMES)), (F.col("id") % len(_GOLD_NAMES) + 1).cast("int"))
    return rows.select("id", kind.alias("kind"), "lang", stamp("event_timestamp_v1", "yyyy-MM-dd").alias("event_v1"), stamp("event_timestamp_v2", "yyyy-MM-dd").alias("event_v2"), "standard_mismatch")


_BOTH = f"WITH {_G}, a AS ({_flags_sql('e1')}), b AS ({_flags_sql('e2')}), j AS (SELECT a.*, b.ex AS ex2, b.re AS re2, b.rh AS rh2 FROM a JOIN b USING (id) WHERE id % 10 > 1)"


@query(_BOTH + """, m AS (SELECT 'exact' AS measure, ex AS x, ex2 AS y FROM j WHERE ev = 1 UNION ALL SELECT 'relaxed', re, re2 FROM j WHERE ev = 1 UNION ALL SELECT 'range', rh, rh2 FROM j WHERE ev = 1)
    SELECT measure, count(*) FILTER (y > x) AS v2_better, count(*) FILTER (y < x) AS v1_better, count(*) FILTER (x = y) AS tie FROM m GROUP BY 1
""")
def head_to_head(spark, sf_dir):
    return evaluate.head_to_head(evaluate.compared(evaluate.aligned(*_versions(spark, sf_dir))))


@query(_BOTH + """, p AS (SELECT lang, count(*) AS sample_count, sum(ev)::BIGINT AS n, round(sum(ex) / nullif(sum(ev), 0), 4) AS e1, round(sum(ex2) / nullif(sum(ev), 0), 4) AS e2, round(sum(re) / nullif(sum(ev), 0), 4) AS r1,
        round(sum(re2) / nullif(sum(ev), 0), 4) AS r2 FROM j GROUP BY GROUPING SETS ((), (lang)))
    SELECT lang, sample_count, n AS evaluable_count_v1, n AS evaluable_count_v2, e1 AS exact_accuracy_v1, e2 AS exact_accuracy_v2, r1 AS relaxed_accuracy_v1, r2 AS relaxed_accuracy_v2,
           round(e2 - e1, 4) AS exact_delta_v2_minus_v1, round(r2 - r1, 4) AS relaxed_delta_v2_minus_v1 FROM p
""")
def language_delta(spark, sf_dir):
    rows = evaluate.language_deltas(evaluate.compared(evaluate.aligned(*_versions(spark, sf_dir))))
    return rows.select("lang", "sample_count", "evaluable_count_v1", "evaluable_count_v2", "exact_accuracy_v1", "exact_accuracy_v2", "relaxed_accuracy_v1", "relaxed_accuracy_v2", "exact_delta_v2_minus_v1", "relaxed_delta_v2_minus_v1")


@query("""
    SELECT count(*) AS v1_count, count(*) AS v2_count, count(*) FILTER (o_orderkey % 10 > 1) AS overlap_count, 0 AS standard_timestamp_mismatch_count,
           count(*) FILTER (o_orderkey % 10 > 1) AS sampled_count FROM orders
""")
def comparison_sizes(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return evaluate.dataset_sizes(v1, v2, evaluate.aligned(v1, v2))


_STRATA = """
    WITH s AS (SELECT lang || '__' || source AS stratum, count(*) AS n FROM documents GROUP BY 1),
    a AS (SELECT *, row_number() OVER (ORDER BY n DESC, stratum) AS turn, sum(n) OVER () AS total FROM s),
    f AS (SELECT *, least(200, total) AS target, CASE WHEN turn <= least(200, total) THEN 1 ELSE 0 END AS first FROM a),
    c AS (SELECT *, target - sum(first) OVER () AS rem, n - first AS room FROM f),
    x AS (SELECT *, CASE WHEN room > 0 THEN rem * (room / sum(room) OVER ()) ELSE 0 END AS exact FROM c),
    d AS (SELECT *, least(floor(exact), room) AS added FROM x),
    r AS (SELECT *, rem - sum(added) OVER () AS rest, first + added >= n AS full_ FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY full_, exact - added DESC, stratum DESC) AS place FROM r)
    SELECT stratum, n, CAST(CASE WHEN 200 >= total THEN n ELSE first + added + CASE WHEN NOT full_ AND place <= rest THEN 1 ELSE 0 END END AS BIGINT) AS take FROM p
"""


@query(_STRATA)
def stratified_allocation(spark, sf_dir):
    strata = table(spark, sf_dir, "documents").groupBy(sampling.stratum(F.col("lang"), F.col("source")).alias("stratum")).agg(F.count("*").alias("n"))
    return sampling.allocation(strata, 200)


@query(f"WITH t AS ({_STRATA}) SELECT stratum, take AS n FROM t WHERE take > 0")
def stratified_sample(spark, sf_dir):
    """How many rows of each stratum a sample of 200 holds; which ones is a matter of the hash."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = sampling.stratified_sample(d, 200, sampling.stratum(F.col("lang"), F.col("source")))
    return rows.groupBy(sampling.stratum(F.col("lang"), F.col("source")).alias("stratum")).agg(F.count("*").alias("n"))


# --- clusters and timelines ------------------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    """Vectors with a stand-in for times, which the table lacks: one of 30 days by key."""
    at = F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(vec_id % 30 as int))")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), at.alias("at"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT count(*) AS pairs, round(min(1 - list_cosine_similarity(a.v, b.v)), 4) AS least, round(avg(1 - list_cosine_similarity(a.v, b.v)), 4) AS mean, round(max(1 - list_cosine_similarity(a.v, b.v)), 4) AS greatest
    FROM e a JOIN e b ON a.vec_id < b.vec_id
""")
def cosine_pairs_stats(spark, sf_dir):
    out = clusters.distance_stats(_vectors(spark, sf_dir))
    return out.select("pairs", *[F.round(c, 4).alias(c) for c in ("least", "mean", "greatest")])


@query("""
    WITH e AS (SELECT vec_id AS id, CAST(vec_id % 30 AS INT) AS day, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT a.id AS id_a, b.id AS id_b, round(1 - list_cosine_similarity(a.v, b.v), 4) AS distance FROM e a JOIN e b ON a.id < b.id AND abs(a.day - b.day) <= 7 AND 1 - list_cosine_similarity(a.v, b.v) <= 0.6
""")
def time_band_pairs(spark, sf_dir):
    return clusters.near_pairs(_vectors(spark, sf_dir), 0.60, 7.0).select("id_a", "id_b", F.round("distance", 4).alias("distance"))


@query("""
    WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(vec_id % 30 AS INT) AS day, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id AND abs(a.day - b.day) <= 7 AND 1 - list_cosine_similarity(a.v, b.v) <= 0.6),
    r AS (SELECT a AS id, b AS seen FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
    m AS (SELECT id, least(id, min(seen)) AS root FROM r GROUP BY id),
    n AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM m)
    SELECT e.id, n.cluster_id IS NULL AS system_is_noise, n.cluster_id FROM e LEFT JOIN n USING (id)
""")
def cluster_components(spark, sf_dir):
    return clusters.clusters(_vectors(spark, sf_dir), 0.60, 7.0)


@query("""
    SELECT a.o_orderkey AS id_a, b.o_orderkey AS id_b, CAST(abs(date_diff('day', a.o_orderdate, b.o_orderdate)) AS BIGINT) AS days
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 7
""")
def window_pairs(spark, sf_dir):
    """Orders of one customer within a week of each other: a band join on buckets of a week."""
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("g"))
    return clusters.banded_pairs(rows, 7.0, by=["g"]).select("id_a", "id_b", F.round("days").cast("long").alias("days"))


@query("""
    WITH e AS (SELECT vec_id AS id, CAST(vec_id % 30 AS INT) AS day, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), t AS (SELECT * FROM e WHERE id = 17)
    SELECT e.id, abs(e.day - t.day) > 7 AS outside, round(1 - list_cosine_similarity(e.v, t.v) + CASE WHEN abs(e.day - t.day) > 7 THEN 2 ELSE 0 END, 4) AS distance FROM e, t WHERE e.id <> t.id
""")
def probe_report(spark, sf_dir):
    """Distances of all vectors to the one whose title holds a word, those beyond the window with the penalty."""
    titles = F.when(F.col("id") == 17, "The Minister spoke").otherwise("Other news")
    return clusters.probe(_vectors(spark, sf_dir).withColumn("title", titles), "Minister").select("id", "outside", F.round("distance", 4).alias("distance"))


@query("""
    WITH b AS (SELECT event_type AS source, min(date_trunc('second', ts)) AS s, max(date_trunc('second', ts)) AS e FROM events GROUP BY 1),
         w AS (SELECT source, e, unnest(generate_series(s, e - INTERVAL 1 SECOND, INTERVAL '7 days 1 second')) AS a FROM b WHERE s < e),
         n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY a) AS i FROM w)
    SELECT source, strftime(max(least(a + INTERVAL 7 DAY, e)) + INTERVAL 1 SECOND, '%Y%m%dT%H%M%SZ') AS next_start_time FROM n WHERE i < 3 GROUP BY source
""")
def checkpoint_advance(spark, sf_dir):
    """The third window of each source fails: checkpoints stop before it."""
    e = ntz(table(spark, sf_dir, "events"), "ts").withColumn("t", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    windows = feeds.fetch_windows(e.groupBy(F.col("event_type").alias("source")).agg(F.min("t").alias("start"), F.max("t").alias("stop")))
    third = F.row_number().over(Window.partitionBy("source").orderBy("window_start")) == 3
    return feeds.advanced(windows, windows.select("source", "window_start", (~third).alias("ok")))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn, role || ': ' || text || chr(10))) AS context_md5 FROM conversations GROUP BY conv_id")
def prompt_context(spark, sf_dir):
    """Turns of each conversation as one text in order, as a digest."""
    block = F.concat(F.col("role"), F.lit(": "), F.col("text"), F.lit("\n"))
    out = timeline.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", block)
    return out.select("conv_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("""
    SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(event_id AS VARCHAR)) - 1 AS position, event_type AS original_title FROM events
""")
def timeline_order(spark, sf_dir):
    """Every user's events in order of time, with titles looked up."""
    e = ntz(table(spark, sf_dir, "events"), "ts")
    items = e.select("user_id", F.col("event_id").cast("string").alias("id"), stamp("ts").alias("parsed_time"), F.col("event_type").alias("title"), F.lit(False).alias("system_is_noise"))
    steps = timeline.titled(timeline.timeline(items, by=["user_id"]), items)
    return steps.select("user_id", F.col("id").cast("long").alias("id"), F.col("position").cast("long").alias("position"), "original_title")
